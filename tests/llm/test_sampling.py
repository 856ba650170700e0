"""Importance resampling, mixing and hard negatives against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweave.llm import hard_negatives as hn
from paperweave.llm import importance as im
from paperweave.llm.common import sums_before
from paperweave.llm.curriculum import SCHEDULES, curriculum_mix, demand, source_targets, time_of
from paperweave.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
NEW = ["op11_line_importance", "op12_curriculum_mix", "op13_segment_hard_negatives"]


@pytest.mark.parametrize("name", NEW)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: repr(r)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)


# ---------------------------------------------------------------- sums before

def test_sums_before_over_parts(spark):
    """Groups that span several parts, null groups and ties."""
    rows = [(None if i % 5 == 0 else "g" if i % 3 else "h", i // 2, i, 1 + i % 4) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, a int, b int, w long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sums_before(df, ["g"], [F.col("a"), F.col("b")], {"s": "w"}).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want, run = {}, Counter()
    for g, _, b, w in sorted(rows, key=lambda r: (r[1], r[2])):
        want[b] = run[g]
        run[g] += w
    assert {r.b: r.s for r in got} == want


# ---------------------------------------------------------------- resampling

def brute_resample(rows, target, percent=25, least=20):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(text):
        w = word.findall((text or "").translate(lower))
        return w + [a + " " + b for a, b in zip(w, w[1:], strict=False)], len(w)

    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    raw = Counter(bucket(f) for _, t in rows for f in features(t)[0])
    goal = Counter(bucket(f) for t in target for f in features(t)[0])
    s, t = sum(raw.values()), sum(goal.values())
    gain = lambda b: math.floor(1000 * math.log((goal[b] + 1.0) * (s + 10000) / ((raw[b] + 1.0) * (t + 10000))))
    out = []
    for i, text in rows:
        f, n = features(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = Counter()
    for k, r in enumerate(able[:len(able) * percent // 100]):
        drawn[(r[:4], k + 1)] += 1
    return Counter(r[:4] for r in out), drawn


def test_resampling_of_awkward_rows(docs, rows, spark):
    long = [(900, "word " * 300_000), (901, "x" * 3_000_000), (902, " " * 3_000_000), (903, "A-b\n\nC d\n" * 5000),
            (904, "y" * 70 + " " + "z" * 65 + "\n" + "y" * 64 + " " + "z" * 64 + "é" * 40)]
    data = [(r[0], r[1]) for r in rows] + long
    more = docs.select("doc_id", "text", "row", "ids").unionByName(
        spark.createDataFrame([(*r, "clash", "clash") for r in long], "doc_id long, text string, row string, ids string"))
    target = [rows[0][1], rows[3][1], "", None]
    got = im.resample(more, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    want, drawn = brute_resample(data, target)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == want
    ranks = [r for r in got if r["rank"] is not None]
    assert sorted(r["rank"] for r in ranks) == list(range(1, sum(drawn.values()) + 1))
    tie = lambda rs: sorted((k, s[3]) for s, k in rs)
    assert tie(((r.doc_id, r.n_features, r.weight, r.score), r["rank"]) for r in ranks) == tie(drawn)


def test_resampling_of_empty_tables(spark, empty, docs):
    none = spark.createDataFrame([], "text string")
    assert im.resample(empty, docs.select("text")).count() == 0
    got = im.resample(docs, none).collect()
    assert len(got) == docs.count()


def test_frequent_lines_are_broadcast_or_joined_alike(spark, monkeypatch):
    rows = [(i, "the same line\n" * (i % 4) + f"line {i % 9} of its own\n" + "Shared, line " * (i % 3)) for i in range(300)]
    df, target = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("the same shared line",)], "text string")
    one = sorted(im.resample(df, target, least_words=2).collect())
    for hot in (0, 3):
        monkeypatch.setattr(im, "HOT", hot)
        assert sorted(im.resample(df, target, least_words=2).collect(), key=lambda r: r.doc_id) == sorted(one, key=lambda r: r.doc_id)
    assert Counter(r[:4] for r in map(tuple, one)) == brute_resample(rows, ["the same shared line"])[0]


def test_crc_of_joined_words():
    zeros = im.zero_bytes(im.SHORT)
    lines = [b"a b", b"one", b"x" * 64 + b" y", b"y " + b"x" * 64, b"y " + b"x" * 65 + b" z", "é ü 中文".encode()]
    flat, n = im.line_features(lines, zeros)
    at = 0
    for line, k in zip(lines, n.tolist(), strict=True):
        w = line.split()
        assert Counter(flat[at:at + 2 * k - 1].tolist()) == Counter(
            zlib.crc32(f) % 10000 for f in w + [a + b" " + b for a, b in zip(w, w[1:], strict=False)])
        at += 2 * k - 1


# ---------------------------------------------------------------- mixing

def water_fill(size, weights, budget=1.5, most=2):
    """Targets by resharing the excess over and over."""
    total, target, capped = budget * sum(size), [0.0] * len(size), set()
    while True:
        free = [i for i in range(len(size)) if i not in capped]
        if not free:
            return target
        rest, w = total - sum(target[i] for i in capped), sum(weights[i] for i in free)
        for i in free:
            target[i] = rest * weights[i] / w
        over = [i for i in free if target[i] > most * size[i]]
        if not over:
            return target
        for i in over:
            target[i] = float(most * size[i])
            capped.add(i)


def test_targets_reshare_the_excess(spark):
    sizes = [("a", 1000), ("b", 30), ("c", 5), ("d", 800), ("\U0001f600", 40), ("￮", 7), (None, 0), ("e", 0)]
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(sizes, "source string, source_size long"), SCHEDULES, 1.5, 2).collect()}
    order = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode()))
    want = water_fill([s[1] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
    assert [got[s[0]] for s in order] == pytest.approx(want)


def test_time_inverts_the_demand(spark):
    schedule = ((0.0, 0.0), (0.25, 4.0), (0.5, 0.0), (0.75, 0.0), (1.0, 1.0))
    upto = demand(schedule)
    got = [r.t for r in spark.range(101).select(time_of(F.col("id") / 100, schedule).alias("t")).orderBy("id").collect()]
    assert got == sorted(got)
    for i, t in enumerate(got):                      # integrate to the time, by the trapezoids
        k = max(j for j in range(len(schedule) - 1) if schedule[j][0] <= t)
        (t0, r0), (t1, r1) = schedule[k], schedule[k + 1]
        here = r0 + (r1 - r0) * (t - t0) / (t1 - t0)
        assert (upto[k] + (r0 + here) / 2 * (t - t0)) / upto[-1] == pytest.approx(i / 100, abs=1e-9)
    with pytest.raises(ValueError):
        demand(((0.0, 1.0), (0.5, 1.0)))


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))


def test_mix_of_awkward_rows(docs, rows, spark):
    many = docs.unionByName(docs.where("doc_id = 400"))
    data = rows + [r for r in rows if r[0] == 400]
    got = curriculum_mix(many).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((r[0], r[3], words(r[1])) for r in data)
    size, taken = Counter(), Counter()
    for r in got:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    want = water_fill([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
    for s, t in zip(order, want, strict=True):
        assert taken[s] == math.floor(t + 0.5)
    for r in got:
        assert r.source_size == size[r.source] and 0 <= r.taken <= 2 * r["size"] and r.taken == sum(c.words for c in r.copies)
    copies = sorted(((c.sequence, c.position, r.source, c.words) for r in got for c in r.copies), key=lambda c: c[0])
    assert [c[0] for c in copies] == list(range(len(copies)))
    assert [c[1] for c in copies] == sorted(c[1] for c in copies)
    # halfway through training, each source has given what its schedule asks for
    for i, s in enumerate(order):
        kind = SCHEDULES[i % 3]
        half = (kind[0][1] + (kind[0][1] + kind[1][1]) / 2) / 2 * 0.5 / demand(kind)[-1]
        before = sum(c[3] for c in copies if c[2] == s and c[1] < 0.5)
        biggest = max(words(r[1]) for r in data if r[3] == s)
        assert abs(before - half * taken[s]) <= biggest + 1


def test_mix_reruns_agree(docs, empty):
    key = lambda rs: sorted(map(repr, rs))
    assert key(curriculum_mix(docs).collect()) == key(curriculum_mix(docs.repartition(5)).collect())
    assert curriculum_mix(empty).count() == 0


def test_mix_is_native(spark):
    text = QUERIES["op12_curriculum_mix"](spark, SF)._jdf.queryExecution().toString()
    assert not any(w in text for w in ("Python", "Pandas", "Arrow"))


# ---------------------------------------------------------------- hard negatives

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", T.IntegerType()),
                        T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("row", T.StringType()),
                        T.StructField("anchor", T.StringType()), T.StructField("score", T.StringType())])


def brute_negatives(rows, positives=5, negatives=10):
    """Rows: (id, label, vector); anchors are ids divisible by 100."""
    good = [(k, i, lab, np.floor(256 * np.asarray(v, np.float32).astype(np.float64)).astype(object)) for k, (i, lab, v) in enumerate(rows)
            if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for k, i, lab, v in good:
        if i is None or i % 100:
            continue
        same, other = [], []
        for k2, j, lab2, u in good:
            if k2 != k and len(u) == len(v):
                (same if lab2 == lab else other).append((int(sum(a * b for a, b in zip(v, u, strict=True))), j))
        for p, pid in sorted(same, key=order)[:positives]:
            fits = sorted((x for x in other if 30 * p <= 100 * x[0] <= 90 * p), key=order)[:negatives]
            for rank, (s, j) in enumerate(fits):
                out[(i, pid, rank + 1, j, p, s)] += 1
    return out


def vector_rows(n=700, dim=24, seed=1):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, dim))
    rows = [(i, int(i % 4), (centres[i % 6] * rnd.choice([0.2, 1.0]) + 0.4 * rnd.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(1000 + i, i % 3, rows[0][2]) for i in range(60)]                   # one vector many times: ties
    rows += [(2000, None, rows[1][2]), (2100, 1, None), (2200, 1, [None] * dim), (2300, 1, [float("nan")] + rows[2][2][1:]),
             (2400, 1, [float("-inf")] + rows[2][2][1:]), (None, 1, rows[4][2]), (None, 2, rows[4][2]), (2500, 1, []), (2501, 1, []),
             (2502, 2, []), (2600, 1, [1.0, 2.0]), (2601, 1, [3.0, 2.0]), (2602, 2, [1.0, 1.5]), (2603, 3, [-5.0, 1.0]),
             (300, 3, rows[300][2]), (2700, 0, [0.0] * dim), (2800, 1, [-x for x in rows[5][2]])]
    return rows


@pytest.mark.parametrize("block,cells", [(hn.ANCHOR_BYTES, hn.CELLS), (2000, 256)])
def test_negatives_equal_brute_force(spark, monkeypatch, block, cells):
    monkeypatch.setattr(hn, "ANCHOR_BYTES", block)
    monkeypatch.setattr(hn, "CELLS", cells)
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], VECTORS).repartition(5)
    got = hn.hard_negatives(df, F.col("vec_id") % 100 == 0).collect()
    assert Counter(map(tuple, got)) == brute_negatives(rows)


def test_negatives_of_empty_tables(spark):
    df = spark.createDataFrame([], VECTORS)
    assert hn.hard_negatives(df, F.col("vec_id") % 100 == 0).count() == 0
    some = spark.createDataFrame([(1, 1, [1.0, 2.0], "", "", "")], VECTORS)
    assert hn.hard_negatives(some, F.col("vec_id") % 100 == 0).count() == 0


def test_bounds_hold_and_prune():
    """No pair within the limits is dropped, and on clustered vectors few are scored."""
    rnd = np.random.default_rng(0)
    centres = np.repeat(rnd.integers(-200, 200, (40, 8)), 8, axis=1)            # segments of equal level
    x = np.floor(centres[rnd.integers(0, 40, 3000)] + rnd.normal(size=(3000, 64)) * 10)
    make = lambda m, row: hn.Rows(row, row, np.zeros(len(m), bool), np.zeros(len(m), np.int64), m,
                                  hn.summaries(m).astype(np.float32))
    a, b = make(x[:20], np.arange(20)), make(x, np.arange(3000))
    search = hn.Search(a, hn.Wanted(np.arange(20), np.full(20, -hn.MOST), np.full(20, hn.MOST), True, 5))
    for lo in range(0, 3000, 500):
        search.add(b.take(slice(lo, lo + 500)))
    q, score, ids, _, _ = search.found()
    exact = x[:20] @ x.T
    np.fill_diagonal(exact, -np.inf)
    want = defaultdict(list)
    for i in range(20):
        want[i] = sorted(((-exact[i, j], j) for j in range(3000)))[:5]
    assert {i: sorted((-s, j) for k, s, j in zip(q, score, ids, strict=True) if k == i) for i in range(20)} == want
    assert search.scored < search.pairs / 3


def test_scores_beyond_doubles_are_exact():
    a = np.array([[2.0 ** 30 + 1, 3.0]])
    b = np.array([[2.0 ** 30 + 3, 5.0]])
    assert hn.exact_scores(a, b)[0, 0] == (2 ** 30 + 1) * (2 ** 30 + 3) + 15
    with pytest.raises(OverflowError):
        hn.exact_scores(a * 2.0 ** 20, b * 2.0 ** 20)
