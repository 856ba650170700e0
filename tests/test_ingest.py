"""Snapshot loading on hand-written JSON lines (FIXTURES section 3)."""

import gzip
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from paperweave.operators.tables import DuplicateKeyError, create_tables, read_table
from paperweave.plans.load import filtered_batch, generic_batch, load_filtered, load_generic
from paperweave.sources.snapshot import LENIENT, STRICT, read_works

URL = "https://x.org/"


def base(n):
    return {"id": f"{URL}W{n}", "doi": f"10.1/{n}", "title": f"t{n}", "type": "article",
            "publication_year": 2000 + n, "cited_by_count": n,
            "concepts": [{"id": f"{URL}C1"}, {"id": f"{URL}C9"}],
            "referenced_works": [f"{URL}W1"],
            "authorships": [{"author": {"display_name": "A"}}],
            "primary_location": {"source": {"display_name": "V"}},
            "abstract_inverted_index": {"The": [0, 2], "cat": [1]}}


def case(n, **change):
    r = base(n)
    for k, v in change.items():
        if v is DROP:
            r.pop(k, None)
        else:
            r[k] = v
    return json.dumps(r)


DROP = object()

CASES = {
    "R1": case(1),
    "R2": case(2, concepts=[{"id": f"{URL}C9"}]),
    "R3": '{"id": "https://x.org/W3", "title": ',
    "R4": case(4, concepts=None),
    "R5": case(5, concepts=DROP),
    "R6": case(6, referenced_works=None),
    "R7": case(7, authorships="oops"),
    "R8": case(8, concepts=[{"id": f"{URL}C1"}, {}]),
    "R9": case(9, id=DROP),
    "R10": case(1, title="dup"),
    "R11": case(11, title=None, type="dataset"),
    "R12": json.dumps({**base(12), "referenced_works": [f"{URL}W1", 5, f"{URL}W2"]}),
    "R13": case(13, referenced_works=[], authorships=[]),
    "R14": case(14, referenced_works=[f"{URL}W14", f"{URL}W1", f"{URL}W1"]),
    "R15": case(15, abstract_inverted_index=None, authorships=None,
                primary_location={"source": None}),
    "R16": case(16, id="W16"),
}
JUNK = ["[]", "", '"str"']


def write_snapshot(root, files):
    """files: {name: [lines]} -> data/works/updated_date=2024-01-0k/name.gz"""
    for k, (name, lines) in enumerate(files.items()):
        d = os.path.join(root, "data", "works", f"updated_date=2024-01-0{k + 1}")
        os.makedirs(d, exist_ok=True)
        with gzip.open(os.path.join(d, name), "wt", encoding="utf-8") as f:
            f.write("\n".join(lines) + "\n")
    return os.path.join(root, "data", "works")


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)


def empty_works(spark):
    from paperweave.schemas import WORKS
    return spark.createDataFrame([], WORKS)


def test_loader_b_cases(spark, tmp):
    path = write_snapshot(tmp, {"part_000.gz": list(CASES.values()) + JUNK})
    raw = read_works(spark, path, LENIENT)
    assert "updated_date" in raw.columns                 # C1 partition discovery
    b = filtered_batch(raw, ["C1"], empty_works(spark))
    works = {r.id: r for r in b.works.collect()}
    assert sorted(works) == sorted(["W1", "W6", "W7", "W11", "W12", "W13", "W14", "W15", "W16"])
    assert works["W1"].title == "t1"                     # R10: first record wins
    assert works["W7"].first_author is None              # R7: wrong type -> null, record kept
    assert works["W13"].first_author is None
    assert works["W15"].abstract_inverted_index is None and works["W15"].venue is None
    assert works["W1"].abstract_inverted_index.replace(" ", "") == '{"The":[0,2],"cat":[1]}'
    cites = sorted((r.source_id, r.target_id) for r in b.citations.collect())
    want = sorted([("W1", "W1"), ("W7", "W1"), ("W1", "W1"), ("W11", "W1"), ("W12", "W1"),
                   ("W12", "5"), ("W12", "W2"), ("W14", "W14"), ("W14", "W1"), ("W14", "W1"),
                   ("W15", "W1"), ("W16", "W1")])
    assert cites == want                                 # 10 + the 2 accepted R12 extras
    m = b.metrics.collect()
    assert len(m) == 1 and m[0].kept == 10 and m[0].total_kept == 10   # before de-duplication


def test_loader_b_existing_rows_stay(spark, tmp):
    path = write_snapshot(tmp, {"a.gz": [CASES["R1"], CASES["R6"]]})
    existing = spark.createDataFrame([("W1", None, "old", None, None, None, None, None)],
                                     empty_works(spark).schema)
    b = filtered_batch(read_works(spark, path), ["C1"], existing)
    assert [r.id for r in b.works.collect()] == ["W6"]


def test_concept_filter_table_form(spark, tmp):
    path = write_snapshot(tmp, {"a.gz": [CASES["R1"], CASES["R2"]]})
    wanted = spark.createDataFrame([("C1",), ("C7",)], "concept_id string")
    b = filtered_batch(read_works(spark, path), wanted, empty_works(spark), metrics=False)
    assert [r.id for r in b.works.collect()] == ["W1"]


def test_loader_a_cases(spark, tmp):
    lines = [CASES[k] for k in ("R1", "R2", "R11", "R13", "R14")]
    path = write_snapshot(tmp, {"a.gz": lines})
    b = generic_batch(read_works(spark, path, STRICT), empty_works(spark))
    assert sorted(r.id for r in b.works.collect()) == [f"{URL}W{n}" for n in (1, 13, 14, 2)]
    cites = sorted((r.source_id, r.target_id) for r in b.citations.collect())
    assert cites == sorted([(f"{URL}W1", f"{URL}W1"), (f"{URL}W2", f"{URL}W1"), (f"{URL}W11", f"{URL}W1"),
                            (f"{URL}W14", f"{URL}W14"), (f"{URL}W14", f"{URL}W1"), (f"{URL}W14", f"{URL}W1")])


def test_loader_a_malformed_rejects(spark, tmp):
    path = write_snapshot(tmp, {"a.gz": [CASES["R1"], CASES["R3"]]})
    with pytest.raises(Exception):
        generic_batch(read_works(spark, path, STRICT), empty_works(spark)).works.collect()


def test_loader_a_duplicate_rejects(spark, tmp):
    path = write_snapshot(tmp, {"a.gz": [CASES["R1"], CASES["R10"]]})
    with pytest.raises(DuplicateKeyError):
        generic_batch(read_works(spark, path, STRICT), empty_works(spark))


def test_load_generic_writes_nothing_on_error(spark, tmp):
    path = write_snapshot(os.path.join(tmp, "snap"), {"a.gz": [CASES["R1"], CASES["R10"]]})
    root = os.path.join(tmp, "db")
    with pytest.raises(DuplicateKeyError):
        load_generic(spark, path, root)
    assert read_table(spark, root, "works").count() == 0
    assert read_table(spark, root, "citations").count() == 0


def test_load_filtered_end_to_end(spark, tmp):
    path = write_snapshot(os.path.join(tmp, "snap"),
                          {"a.gz": [CASES[k] for k in ("R1", "R6", "R7")],
                           "b.gz": [CASES[k] for k in ("R10", "R14")], "skip.json": [CASES["R16"]]})
    root = os.path.join(tmp, "db")
    idx = os.path.join(tmp, "idx")
    load_filtered(spark, path, ["C1"], root, load_id="L1", index_path=idx)
    works = sorted(r.id for r in read_table(spark, root, "works").collect())
    assert works == ["W1", "W14", "W6", "W7"]            # C2: skip.json not read
    assert read_table(spark, root, "citations").count() == 2 + 3 + 1
    # a second load of the same files keeps works unique; a new load id adds citations again
    load_filtered(spark, path, ["C1"], root, load_id="L2")
    assert read_table(spark, root, "works").count() == 4
    assert read_table(spark, root, "citations").count() == 12
    # re-running load L2 replaces its own citation files
    load_filtered(spark, path, ["C1"], root, load_id="L2")
    assert read_table(spark, root, "citations").count() == 12
    assert spark.read.parquet(f"{idx}/postings").count() > 0


def test_k1_create_tables_idempotent(spark, tmp):
    root = os.path.join(tmp, "db")
    create_tables(spark, root)
    spark.createDataFrame([("W1", "x")], "source_id string, target_id string").write.mode("append").parquet(
        f"{root}/citations")
    create_tables(spark, root)
    assert read_table(spark, root, "citations").count() == 1


def test_c4_corrupt_gzip(spark, tmp):
    lines = [case(n) for n in range(1, 3001)]
    path = write_snapshot(tmp, {"big.gz": lines})
    f = os.path.join(path, "updated_date=2024-01-01", "big.gz")
    data = open(f, "rb").read()
    with open(f, "wb") as out:
        out.write(data[: len(data) // 2])
    n = read_works(spark, path, LENIENT, ignore_corrupt_files=True).count()
    assert 0 < n < 3000
    with pytest.raises(Exception):
        read_works(spark, path, LENIENT).count()


def test_n3_stream_incremental(spark, tmp):
    from paperweave.streaming.incremental import stream_filtered
    snap = os.path.join(tmp, "snap")
    root, ckpt = os.path.join(tmp, "db"), os.path.join(tmp, "ckpt")
    os.makedirs(snap)

    def put(name, keys):
        with gzip.open(os.path.join(snap, name), "wt") as f:
            f.write("\n".join(CASES[k] for k in keys) + "\n")

    put("a.gz", ["R1", "R2", "R6", "R7"])
    stream_filtered(spark, snap, ["C1"], root, ckpt).awaitTermination(120)
    assert sorted(r.id for r in read_table(spark, root, "works").collect()) == ["W1", "W6", "W7"]
    put("b.gz", ["R10", "R14", "R16"])
    stream_filtered(spark, snap, ["C1"], root, ckpt).awaitTermination(120)
    stream_filtered(spark, snap, ["C1"], root, ckpt).awaitTermination(120)   # nothing new
    works = read_table(spark, root, "works").collect()
    assert sorted(r.id for r in works) == ["W1", "W14", "W16", "W6", "W7"]
    assert [r.title for r in works if r.id == "W1"] == ["t1"]
    assert read_table(spark, root, "citations").count() == 2 + 1 + 3 + 1


def test_concept_filter_large_table_path(spark, tmp, monkeypatch):
    import paperweave.operators.filters as flt
    monkeypatch.setattr(flt, "MAX_CONCEPT_ARRAY", 0)
    path = write_snapshot(tmp, {"a.gz": [CASES["R1"], CASES["R2"], CASES["R8"], CASES["R14"]]})
    wanted = spark.createDataFrame([("C1",)], "concept_id string")
    b = filtered_batch(read_works(spark, path), wanted, empty_works(spark), metrics=False)
    assert sorted(r.id for r in b.works.collect()) == ["W1", "W14"]
