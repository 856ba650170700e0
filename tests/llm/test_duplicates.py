"""SimHash groups, repeated substrings and benchmark windows, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from brute import repeats_removed, simhash_components
from fixtures import dealt_out, frame, prose

import paperweave.llm.components as components_of
import paperweave.llm.decontaminate as dc
import paperweave.llm.simhash as sh
import paperweave.llm.substrings as sub
from paperweave.llm.components import components, local_components
from paperweave.llm.suffix_arrays import permuted_common_prefixes, repeated_windows, suffix_array


def near_rows():
    """Long texts with a word changed: fingerprints a few bits apart."""
    rnd = random.Random(8)
    rows = []
    for g in range(6):
        words = prose(rnd, 300).split()
        for k in range(8):
            w = list(words)
            for _ in range(k % 4):
                w[rnd.randrange(len(w))] = "changed"
            rows.append((1000 * g + 7 * k + 3, " ".join(w), "en", "a"))
    return rows


def test_simhash_groups(docs, rows, spark):
    got = Counter(map(tuple, sh.near_duplicates(docs).collect()))
    assert got == Counter(simhash_components([(r[0], r[1]) for r in rows]))
    near = near_rows()
    got = sh.near_duplicates(frame(spark, near)).collect()
    assert Counter(map(tuple, got)) == Counter(simhash_components([(r[0], r[1]) for r in near]))
    assert len({r.fingerprint for r in got}) > len({r.component_id for r in got})


def test_small_tables_are_few_files(spark, monkeypatch):
    """Tables of few rows are one file each after the first links, however many shuffle partitions there are."""
    files, keep = [], components_of.stored

    def seen(df, name):
        out = keep(df, name)
        files.append((name, len(out.inputFiles())))
        return out

    for module in (sh, components_of):
        monkeypatch.setattr(module, "stored", seen)
    near = near_rows()
    with dealt_out(spark):
        got = sh.near_duplicates(frame(spark, near)).collect()
    assert Counter(map(tuple, got)) == Counter(simhash_components([(r[0], r[1]) for r in near]))
    counts = [n for name, n in files if name in ("distinct", "tiles", "large", "small", "rooted")]
    assert len(counts) >= 5 and set(counts) == {1}


def test_few_documents_are_grouped_in_place(spark, monkeypatch):
    """Few fingerprints are grouped and linked without all shuffle partitions, and few documents come back in few parts."""
    files, keep = [], components_of.stored

    def seen(df, name):
        out = keep(df, name)
        files.append((name, len(out.inputFiles())))
        return out

    for module in (sh, components_of):
        monkeypatch.setattr(module, "stored", seen)
    near = near_rows()
    with dealt_out(spark):
        left = sh.one_per_group(frame(spark, near))
        assert left.rdd.getNumPartitions() == 1
        got = Counter(r.doc_id for r in left.collect())
    firsts = {c for _, _, c in simhash_components([(r[0], r[1]) for r in near])}
    assert set(got) == firsts
    assert {n for name, n in files if name != "fingerprints"} == {1} and "links" in dict(files)


def test_few_tiles_meet_without_a_shuffle(spark, monkeypatch):
    """Few fingerprints are broadcast to their neighbours; more than BROADCAST_PRINTS give the same components by a shuffle."""
    prints = [sh.fingerprint(r[1].encode(), 3) for r in near_rows()]
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in sorted(set(prints))], "fp long")
    few = sh.fingerprint_links(df, 3, df.count())
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    roots = {r.node: r.root for r in components_of.components(few).collect()}
    monkeypatch.setattr(sh, "BROADCAST_PRINTS", 0)
    many = components_of.components(sh.fingerprint_links(df, 3, df.count()))
    assert roots and roots == {r.node: r.root for r in many.collect()}


def test_tiles_of_one_cell_are_all_compared(monkeypatch, spark):
    """Small tiles and strips, a chain of fingerprints, and one far away."""
    monkeypatch.setattr(sh, "TILE", 4)
    monkeypatch.setattr(sh, "STRIP", 8)
    rnd = random.Random(4)
    base = rnd.getrandbits(64)
    chain = [base]
    for _ in range(40):
        x = chain[-1]
        for b in rnd.sample(range(64), 3):
            x ^= 1 << b
        chain.append(x)
    swapped = [base ^ (1 << i) ^ (1 << j) for i in range(0, 64, 7) for j in range(3, 64, 9) if i != j]
    prints = np.array(sorted({*chain, *swapped, base ^ ((1 << 64) - 1)}), np.uint64)
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    root = {r.node: r.root for r in components(sh.fingerprint_links(df, 3)).collect()}
    i, j = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3)
    label = local_components(len(prints), i, j)
    signed = prints.view(np.int64).tolist()
    groups = lambda of: {frozenset(x for x in signed if of(x) == of(y)) for y in signed}
    place = {p: k for k, p in enumerate(signed)}
    assert groups(lambda x: root.get(x, x)) == groups(lambda x: label[place[x]])


def test_steps_cover_all_differences_once():
    steps = sh._steps(3)
    assert len(steps) == 65 and len({*steps, *[tuple(-x for x in s) for s in steps]}) == 129


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(5, 5), (3, 2), (3, 2), (None, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 80)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_per_group(docs, rows, spark, empty):
    got = sh.one_per_group(docs)
    assert got.columns == docs.columns
    kept = got.collect()
    named = simhash_components([(r[0], r[1]) for r in rows])
    roots = simhash_components([(r[0], r[1]) for r in rows], roots=True)
    owner = {(r[0], r[1]): (g, n[2]) for r, n, g in zip(rows, named, roots, strict=True)}
    assert sorted(owner[r.doc_id, r.text][0] for r in kept) == sorted(set(roots))
    assert all(r.doc_id == owner[r.doc_id, r.text][1] for r in kept)
    only_null = frame(spark, [(None, "same words here", "en", "a")] * 4 + [(None, "quite other ones", "en", "a")])
    assert sh.one_per_group(only_null).count() == 2
    assert sh.near_duplicates(only_null).where("component_id is not null").count() == 0
    assert sh.one_per_group(empty).count() == 0 and sh.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_and_prefixes(seed, monkeypatch):
    import paperweave.llm.suffix_arrays as sa
    rnd = random.Random(seed)
    for k in range(60):
        monkeypatch.setattr(sa, "DENSE", rnd.choice([1, 4, 64]))
        sigma, n = rnd.choice([2, 3, 5, 200]), rnd.randrange(1, 150)
        b = bytes(rnd.randrange(1, sigma + 1) for _ in range(n))
        b = (b[:7] * 40)[:n] if k % 5 == 0 else b
        t = np.concatenate([np.frombuffer(b, np.uint8), np.zeros(1, np.uint8)])
        order = suffix_array(t, sigma + 1)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tobytes())
        lcp = permuted_common_prefixes(t, order)
        for x, y in zip(order, order[1:]):
            k = 0
            while max(x, y) + k < len(t) and t[x + k] == t[y + k]:
                k += 1
            assert lcp[y] == k
        pieces = [bytes(rnd.choices(b"ab", k=rnd.randrange(30))) for _ in range(5)]
        seen = Counter(p[i:i + 4] for p in pieces for i in range(len(p) - 3))
        assert [f.tolist() for f in repeated_windows(pieces, 4)] == [[seen[p[i:i + 4]] > 1 for i in range(len(p) - 3)] for p in pieces]


@pytest.mark.parametrize("hot", [4096, 2])
def test_removed_repeats(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(sub, "HOT", hot)
    monkeypatch.setattr(sub, "SHARD", 5000)
    want = Counter((r[0], *x) for r, x in zip(rows, repeats_removed([(r[1] or "").encode() for r in rows]), strict=True))
    got = sub.remove_repeats(docs)
    assert Counter(map(tuple, got.collect())) == want
    assert any(0 < r.n_removed < r.n_bytes for r in got.collect())


def test_intermediate_tables_can_be_dropped(spark):
    import os

    from paperweave.llm.common import _folder, drop_stored, stored
    stored(spark.range(3), "gone")
    path = _folder(spark).removeprefix("file:")
    assert os.listdir(path)
    drop_stored(spark)
    assert not os.path.exists(path) and not any(t.name.startswith("pw_texts_") for t in spark.catalog.listTables())


def test_kept_bytes(docs, rows, empty):
    import hashlib
    for r in sub.remove_repeats(docs, with_text=True).collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed
    assert sub.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        sub.remove_repeats(docs, size=10)


def test_windows_are_in_one_context_each():
    rnd = random.Random(6)
    texts = [bytes(rnd.choices(b"abc ", k=rnd.randrange(900))) for _ in range(30)] + [b"z" * 700, b"", b"x" * 199, b"x" * 200]
    gram, doc, lo, hi = sub.contexts(texts, 200, run_bytes=2000)
    windows = [(d, w) for d, a, b in zip(doc.tolist(), lo.tolist(), hi.tolist()) for w in range(a, b + 1)]
    assert sorted(windows) == [(d, w) for d, t in enumerate(texts) for w in range(len(t) - 199)]
    by_content = {}
    for g, d, a, b in zip(gram.tolist(), doc.tolist(), lo.tolist(), hi.tolist()):
        for w in range(a, b + 1):
            assert by_content.setdefault(texts[d][w:w + 200], g) == g


def benchmark_rows():
    rnd = random.Random(12)
    items = [(i, prose(rnd, rnd.randint(15, 60))) for i in range(25)]
    items += [(90, "one two three"), (91, ""), (92, None), (93, "Single"), (None, prose(rnd, 30)), (94, items[0][1])]
    docs = []
    for i in range(60):
        text = prose(rnd, rnd.randint(30, 300)).split(" ")
        if i % 2:
            words = (items[i % 25][1]).split(" ")
            if i % 3 == 0:
                words = words[:1] + [w.upper() for w in words[1:-1]]         # the last word is cut, case changed
            if i % 10 == 5:
                words[len(words) // 2] = "replaced"
            text[5:5] = words
        docs.append((i, " ".join(text), "en", "a"))
    docs += [(70, "x one two, three y", "en", "a"), (71, "one two", "en", "a"), (72, None, None, None), (73, "", "en", "a"),
             (74, items[3][1], "en", "a"), (74, items[3][1], "en", "a"), (None, items[4][1] + " tail", "en", "a"),
             (75, "word " * 20_000 + items[5][1], "en", "a"), (76, "a SINGLE one", "en", "a")]
    return docs, items


def brute_matches(docs, items):
    """Every window of every size of an item, without fingerprints."""
    out = {}
    for d, (_, t, *_) in enumerate(docs):
        words = dc.words_of((t or "").encode())
        for i, (_, x) in enumerate(items):
            own = dc.words_of((x or "").encode())
            if not own:
                continue
            k = min(5, len(own))
            want, n = dc._shingles(own, k), len(own)
            have = {tuple(words[a:a + k]) for a in range(len(words) - k + 1)}
            if sum(c for s, c in want.items() if s in have) < 0.6 * sum(want.values()):
                continue
            best = max((dc.weighted_similarity(dc._shingles(words[a:a + n], k), want) for a in range(len(words) - n + 1)), default=0)
            if best >= 0.8:
                out[d, i] = best
    return out


def test_benchmark_matches(spark, empty, monkeypatch):
    rows, items = benchmark_rows()
    docs = frame(spark, rows)
    bench = spark.createDataFrame([(*x, "clash") for x in items], "item_id int, text string, id string")
    want = brute_matches(rows, items)
    as_rows = Counter((rows[d][0], items[i][0], round(s, 9)) for (d, i), s in want.items())
    for batch in (10_000, 7):
        monkeypatch.setattr(dc, "BATCH_ITEMS", batch)
        got = dc.benchmark_matches(docs, bench)
        assert Counter((r.doc_id, r.item_id, round(r.similarity, 9)) for r in got.collect()) == as_rows
    assert len(want) > 25
    bad = {d for d, _ in want}
    kept = dc.without_benchmark(docs, bench)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((r[0], r[1]) for d, r in enumerate(rows) if d not in bad)
    none = spark.createDataFrame([], bench.schema)
    assert dc.benchmark_matches(docs, none).count() == 0 and dc.without_benchmark(docs, none).count() == len(rows)
    assert dc.benchmark_matches(empty, bench).count() == 0 and dc.without_benchmark(empty, bench).count() == 0


def test_multi_index_finds_all_within_the_radius():
    rnd = random.Random(3)
    index = dc.Index([prose(rnd, 30).encode() for _ in range(60)])
    kinds = {n for n in index.kinds}
    for kind in kinds:
        own = index.kinds[kind]
        near = []
        for i in own:
            for flips in range(dc.RADIUS + 4):
                x = int(index.prints[i])
                for b in rnd.sample(range(64), flips):
                    x ^= 1 << b
                near.append(x)
        prints = np.array(near, np.uint64)
        w, i = index.near(kind, prints)
        a, b = np.nonzero(np.bitwise_count(prints[:, None] ^ index.prints[own][None, :]) <= dc.RADIUS)
        assert set(zip(w.tolist(), i.tolist())) == {(x, own[y]) for x, y in zip(a.tolist(), b.tolist())}
