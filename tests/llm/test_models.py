"""Language model, quality rules and the pipeline."""

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from brute import all_secrets, quality_counts, simhash_components
from fixtures import dealt_out, frame, prose
from pyspark.sql import functions as F

import corpus_pipeline
import paperweave.llm.maxent_lm as lm
import paperweave.llm.quality as q
from paperweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_base(rows, held_out):
    tokens = [(t or "").encode().lower().split() + [b""] for _, t in rows]
    c = Counter(w for (d, _), ws in zip(rows, tokens, strict=True) if not held_out(d) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(d, bool(held_out(d)), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
            for (d, _), ws in zip(rows, tokens, strict=True)]


def out(d):
    return crc32(b"" if d is None else str(d).encode()) % 7 == 2


def part():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2


@pytest.mark.parametrize("known", [1 << 19, 20])
def test_base_scores(docs, rows, monkeypatch, known):
    monkeypatch.setattr(lm, "KNOWN", known)
    monkeypatch.setattr(lm, "FLUSH", 500)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens), r) for r in lm.lm_scores(docs, part()).collect())
    want = sorted(((w[0] is None, w[0] or 0, w[2]), w) for w in brute_base([(r[0], r[1]) for r in rows], out))
    assert len(got) == len(want)
    for (_, g), (_, w) in zip(got, want, strict=True):
        assert (g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:5]
        assert abs(g.base_score - w[5]) < 1e-6 * max(1, abs(w[5])) and g.score < 0


def test_no_training_rows_and_empty_tables(docs, rows, empty):
    got = lm.lm_scores(docs, F.lit(True)).collect()
    assert len(got) == len(rows) and all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in got)
    assert lm.lm_scores(empty, part()).count() == 0


def test_probabilities_add_up():
    v = lm.Vocabulary([b"", b"a", b"b"], np.array([5, 3, 2]), np.array([0, 1, 2]), 10, 3,
                      np.zeros(lm.BUCKETS, np.int64), np.zeros(lm.BUCKETS, np.int64))
    weights = [np.random.default_rng(2).normal(size=(n, k)).astype(np.float32) for n, k in zip(lm.ROWS, (lm.CLASSES, lm.SLOTS))]
    model = lm.Model(v, weights)
    _, _, _, _, _, features, _ = model.read([b"a b a"])
    every = np.arange(lm.CLASSES * lm.SLOTS)
    for at in range(features.shape[1]):
        p = np.exp(model.log_probability(every, np.repeat(features[:, at:at + 1], len(every), axis=1)))
        assert abs(p.sum() - 1) < 1e-3


def test_model_beats_the_base_on_held_out_documents(spark):
    """The order of words tells the next one; unigrams can't see it."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    after = {w: rnd.sample(words, 3) for w in words}

    def text():
        w, ws = rnd.choice(words), []
        for _ in range(150):
            ws.append(w)
            w = rnd.choice(after[w])
        return " ".join(ws)

    docs = spark.createDataFrame([(i, text()) for i in range(250)], "doc_id long, text string")
    got = [r for r in lm.lm_scores(docs, part()).collect() if r.held_out]
    assert len(got) > 20
    gain = sum(r.score - r.base_score for r in got) / sum(r.n_tokens for r in got)
    assert gain > 0.5                            # of log10(40 / 3) = 1.12 at most
    assert lm.lm_scores(docs, part()).where("score > 0").count() == 0


def chain(spark, words, texts, length, seed=6):
    """Texts in which each word has three successors."""
    rnd = random.Random(seed)
    after = {w: rnd.sample(words, 3) for w in words}

    def text():
        w, ws = rnd.choice(words), []
        for _ in range(length):
            ws.append(w)
            w = rnd.choice(after[w])
        return " ".join(ws)

    return spark.createDataFrame([(i, text()) for i in range(texts)], "doc_id long, text string").coalesce(1)


def test_history_tells_thousands_of_words_apart(spark):
    """All words have one ending, hence one bucket."""
    got = [r for r in lm.lm_scores(chain(spark, [f"{i}end" for i in range(3000)], 400, 800), part()).collect() if r.held_out]
    assert len(got) > 20
    gain = sum(r.score - r.base_score for r in got) / sum(r.n_tokens for r in got)
    assert gain > 0.5


def test_probabilities_of_all_leaves_add_up():
    rng = np.random.default_rng(3)
    leaves = lm.leaves_for(5)
    v = lm.Vocabulary([b"", b"a", b"b"], np.array([5, 3, 2]), np.array([0, 1, 2]), 10, 3,
                      rng.integers(0, 9, leaves), np.ones(leaves, np.int64))
    model = lm.Model(v, [rng.normal(size=(n, k)).astype(np.float32) for n, k in zip(lm.ROWS, lm.WIDTHS)])
    features = model.read([b"a b a"])[5]
    every = np.arange(lm.SINGLE + leaves)
    for at in range(features.shape[1]):
        p = np.exp(model.log_probability(every, np.repeat(features[:, at:at + 1], len(every), axis=1)))
        assert abs(p.sum() - 1) < 1e-3
    assert leaves < lm.leaves_for(10 ** 7) < lm.leaves_for(10 ** 9)


def test_rows_follow_the_counted_histories(spark):
    docs = chain(spark, [f"w{i}" for i in range(2000)], 60, 300, seed=8)
    seen = set()
    for r in docs.collect():
        ws = [None, None, *r.text.split(), ""]
        seen |= {x for a, b in zip(ws, ws[1:-1]) for x in ((1, b), (2, a, b), (3, a))}
    got = lm.distinct_histories(lm.count_tokens(docs))
    assert abs(got / len(seen) - 1) < 0.15
    assert lm.distinct_histories(lm.count_tokens(docs.limit(1).select(F.lit("a b").alias("text")))) == 3 + 3 + 2
    sizes = [lm.rows_for(10 ** k) for k in range(1, 12)]
    assert sizes[0] == lm.ROWS and sizes == sorted(sizes) and sizes[5] < sizes[8] < sizes[10]


def test_words_beyond_the_known_keep_their_identity():
    zeros = np.zeros(lm.BUCKETS, np.int64)
    few = lm.Vocabulary([b""], np.array([5]), np.array([0]), 5, 1, zeros, zeros)
    more = lm.Vocabulary([b"", b"xing", b"ying"], np.array([5, 3, 2]), np.array([0, 1, 2]), 10, 3, zeros, zeros)
    texts = [b"xing ying zing", b"", b"zing xing"]
    features = lm.Model(few, None).read(texts)[5]
    assert (features == lm.Model(more, None).read(texts)[5]).all()
    assert len(set(features[0].tolist())) == 4              # a mark and three words of one ending


def test_query_over_whole_documents(spark):
    got = QUERIES["op4_maxent_scores"](spark, SF)
    assert got.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert got.count() == 200


def test_counts_of_awkward_texts(docs, rows):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in q.quality_verdicts(docs).collect())
    assert got == Counter((r[0], *quality_counts(r[1])) for r in rows)


@pytest.mark.parametrize("seed", range(3))
def test_counts_of_random_texts(seed):
    rnd = random.Random(seed)
    texts = ["".join(rnd.choices(["a ", "b ", "\n", "#", "é ", "\t", "A", "\x0b", " ", "x y z\n"], k=rnd.randrange(120)))
             for _ in range(150)] + [""]
    got = q.count_texts([t.encode() for t in texts])
    for i, t in enumerate(texts):
        want = quality_counts(t)
        assert tuple(int(got[c][i]) for c in q.COUNTS[:5]) == want[:5]
        assert got["n_distinct"][i] == len(set(t.encode().split())) and got["n_lines"][i] == t.count("\n") + 1


def quality_rows():
    rnd = random.Random(9)
    rows = [(i, prose(rnd, rnd.randint(60, 500)), "en" if i % 2 else "de", "a") for i in range(300)]
    rows += [(1000 + i, " ".join(w.upper() + "$$$" for w in prose(rnd, 150).split()), "en", "a") for i in range(40)]
    rows += [(2000 + i, "\n".join([prose(rnd, 4)] + ["the same line again " + str(i)] * 3 + [prose(rnd, 60)] + ["spam"] * 30), "de", "a")
             for i in range(25)]
    return rows


def test_outliers_go_and_clean_documents_stay(spark):
    got = {r.doc_id: r for r in q.quality_verdicts(frame(spark, quality_rows())).collect()}
    assert sum(got[i].kept for i in range(300)) == 300
    assert not any(got[i].kept for i in got if i >= 1000)
    assert all(r.base_failed or r.distance is not None for r in got.values())


def test_estimate_against_numpy(spark):
    """The last estimate of a contaminated group is near that of its clean part."""
    rnd = np.random.default_rng(7)
    clean = rnd.normal(size=(400, q.P)) * 0.3 + 2
    clean[:, 1] += 0.8 * clean[:, 0]
    x = np.vstack([clean, rnd.normal(size=(80, q.P)) * 0.1 + 9])
    df = spark.createDataFrame([("g", *[int(round(v * q.UNIT)) for v in r]) for r in x],
                               "_g string, " + ", ".join(f"_x{i} long" for i in range(q.P)))
    est = q.estimates(df).first()
    mean = np.array([est[f"m{i}"] for i in range(q.P)])
    assert np.abs(mean - clean.mean(axis=0)).max() < 0.08
    inv = np.zeros((q.P, q.P))
    for i in range(q.P):
        for j in range(i, q.P):
            inv[i, j] = inv[j, i] = est[f"a{i}_{j}"]
    cov = np.linalg.inv(inv) - np.diag(np.square(q.FLOOR))
    assert np.abs(cov - np.cov(clean.T)).max() < 0.05


def test_half_of_the_lines_duplicated_is_rejected(spark):
    """A moderate outlier in one statistic only, in a group without any."""
    rnd = random.Random(5)
    line = lambda: " ".join(prose(rnd, 5).split())
    rows = [(i, "\n".join(line() for _ in range(16)), "en", "a") for i in range(200)]
    for i in range(3):                                       # no two lines follow each other twice: no repeated windows
        own = [line() for _ in range(8)]
        rows.append((1000 + i, "\n".join(own + [own[k] for k in (3, 0, 5, 1, 6, 2, 7, 4)]), "en", "a"))
    got = {r.doc_id: r for r in q.quality_verdicts(frame(spark, rows)).collect()}
    assert not any(got[1000 + i].kept for i in range(3)) and not any(got[1000 + i].base_failed for i in range(3))
    assert sum(got[i].kept for i in range(200)) >= 198


def test_least_determinant_of_the_starts(spark):
    """The subset found is no worse than those of a numpy search from many starts."""
    rnd = np.random.default_rng(3)
    x = np.vstack([rnd.normal(size=(260, q.P)) * 0.4, rnd.normal(size=(120, q.P)) * 0.4 + 1.6])
    whole = np.rint(x * q.UNIT).astype(int)
    df = spark.createDataFrame([("g", *map(int, r)) for r in whole], "_g string, " + ", ".join(f"_x{i} long" for i in range(q.P)))
    est = q.estimates(df).first()
    x, h = whole / q.UNIT, int(np.ceil(q.SHARE * len(x)))
    floor = np.diag(np.square(q.FLOOR))
    factor = q.SHARE / q.chi2_below(q.chi2_quantile(q.SHARE, q.P), q.P + 2)

    def subset(mean, inv):
        d = np.einsum("ni,ij,nj->n", x - mean, inv, x - mean)
        return x[np.argsort(d)[:h]]

    def det(s):
        return np.linalg.slogdet(np.cov(s.T, bias=True) * factor + floor)[1]

    best = np.inf
    for _ in range(40):
        s = x[rnd.choice(len(x), q.P + 2, replace=False)]
        for _ in range(q.STEPS):
            s = subset(s.mean(axis=0), np.linalg.inv(np.cov(s.T, bias=True) * factor + floor))
        best = min(best, det(s))
    inv = np.zeros((q.P, q.P))
    for i in range(q.P):
        for j in range(i, q.P):
            inv[i, j] = inv[j, i] = est[f"a{i}_{j}"]
    mine = det(subset(np.array([est[f"m{i}"] for i in range(q.P)]), inv))
    assert mine <= best + 0.15


def test_chi_square():
    assert abs(q.chi2_quantile(0.95, 8) - 15.5073) < 1e-3 and abs(q.chi2_below(18.307, 10) - 0.95) < 1e-4


def test_small_groups_are_pooled(spark, empty):
    rnd = random.Random(2)
    few = frame(spark, [(i, prose(rnd, 80), "en", f"s{i}") for i in range(30)] + [(99, "$ " * 300, None, None)])
    got = {r.doc_id: r for r in q.quality_verdicts(few).collect()}
    assert all(r.distance is None and r.kept == (not r.base_failed) for r in got.values())
    pooled = frame(spark, [(i, prose(rnd, 80), "en", f"s{i}") for i in range(80)] + [(99, prose(rnd, 80).upper(), "en", "t")])
    got = {r.doc_id: r for r in q.quality_verdicts(pooled).collect()}
    assert all(r.distance is not None for r in got.values()) and not got[99].kept and sum(r.kept for r in got.values()) == 80
    assert q.quality_verdicts(empty).count() == 0 and q.quality_filter(empty).count() == 0


def test_groups_are_joined_by_one_long(spark, monkeypatch):
    """Broadcast tables by a long have the size of their rows; numbered groups have the estimates of named ones."""
    rnd = np.random.default_rng(4)
    x = [(g, *map(int, r)) for g in (5, 1 << 40) for r in np.rint(rnd.normal(size=(60, q.P)) * q.UNIT)]
    numbered = spark.createDataFrame(x, "_g long, " + ", ".join(f"_x{i} long" for i in range(q.P)))
    joined, step = [], q._concentrated

    def seen(rows, est, sizes, groups):
        out = step(rows, est, sizes, groups)
        joined.append((rows.schema["_g"].dataType.simpleString(), out.schema["_g"].dataType.simpleString()))
        return out

    monkeypatch.setattr(q, "_concentrated", seen)
    values = lambda df: sorted(map(tuple, df.select(F.col("_g").cast("string"), "n", "m0", "a0_1").collect()))
    assert values(q.estimates(numbered)) == values(q.estimates(numbered.withColumn("_g", F.col("_g").cast("string"))))
    assert joined == [("bigint", "bigint")] * q.STEPS + [("string", "string")] * q.STEPS
    counted = spark.createDataFrame([("en", f"en{i % 2}") for i in range(200)] + [("de", "de")] * 60, "_lang string, _both string")
    pools = {r._both: r._g for r in q._pools(counted).collect()}
    assert len(set(pools.values())) == len(pools) == 3 and all(isinstance(g, int) for g in pools.values())


def test_small_tables_of_groups_are_few_files(spark, monkeypatch):
    """A table with a row per group is a file for each TASK_GROUPS of them, however many shuffle partitions there are."""
    rnd = np.random.default_rng(6)
    x = [(g, *map(int, r)) for g in range(6) for r in np.rint(rnd.normal(size=(60, q.P)) * q.UNIT)]
    rows = spark.createDataFrame(x, "_g long, " + ", ".join(f"_x{i} long" for i in range(q.P)))
    files, keep = [], q.stored

    def seen(df, name):
        out = keep(df, name)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(q, "stored", seen)
    with dealt_out(spark):
        assert q.estimates(rows, 6).count() == 6
        named = spark.createDataFrame([("en", f"en{i % 9}") for i in range(900)], "_lang string, _both string")
        assert q._pools(named).rdd.getNumPartitions() == 1
    assert files[:4 + q.STEPS] == [1] * (4 + q.STEPS)


def test_few_rows_are_grouped_in_place(spark, monkeypatch):
    """Few feature rows are grouped without all shuffle partitions, each of which would take pages of memory."""
    rnd = random.Random(2)
    tables, keep = [], q.stored

    def seen(df, name):
        if name != "features":
            tables.append((name, df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning")))
        out = keep(df, name)
        tables.append((name, len(out.inputFiles()) - 1))
        return out

    pooled = frame(spark, [(i, prose(rnd, 80), "en", f"s{i}") for i in range(80)] + [(99, prose(rnd, 80).upper(), "en", "t")])
    want = sorted(r.doc_id for r in q.quality_filter(pooled).collect())
    monkeypatch.setattr(q, "stored", seen)
    with dealt_out(spark):
        got = sorted(r.doc_id for r in q.quality_filter(pooled).collect())
    assert got == want == list(range(80))
    assert {n for name, n in tables if name in ("sizes", "groups", "medians", "best", "estimate")} == {0}


def test_filter_keeps_rows_and_columns(docs, rows):
    kept = q.quality_filter(docs)
    assert kept.columns == docs.columns
    verdict = Counter(r.doc_id for r in q.quality_verdicts(docs).where("kept").collect())
    assert Counter(r.doc_id for r in kept.collect()) == verdict and kept.first().kept == "clash"


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage by other means, on what the stage before kept."""
    import sentencepiece

    import paperweave.llm.decontaminate as dc
    from paperweave.llm.queries import TOKENIZERS
    rnd = random.Random(21)
    rows = quality_rows()
    items = [(i, prose(rnd, 25)) for i in range(5)]
    rows += [(3000 + i, rows[i][1], "en", "a") for i in range(12)]
    rows += [(4000 + i, prose(rnd, 90) + " " + items[i][1] + " " + prose(rnd, 90), "en", "a") for i in range(5)]
    rows += [(5000 + i, prose(rnd, 90) + " password=abcdefabcdef0123 " + prose(rnd, 90), "en", "a") for i in range(5)]
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    verdicts = {r.doc_id: r.kept for r in q.quality_verdicts(docs).collect()}
    assert all(not verdicts[r[0]] for r in rows if quality_counts(r[1])[-1])
    left = [r for r in rows if verdicts[r[0]]]
    left = [r for r, (d, _, c) in zip(left, simhash_components([(r[0], r[1]) for r in left]), strict=True) if d == c]
    held = [dc.words_of(x.encode()) for _, x in items]
    has = lambda ws, x: any(ws[a:a + len(x)] == x for a in range(len(ws)))
    left = [r for r in left if not any(has(dc.words_of(r[1].encode()), x) for x in held)]
    want = {}
    for r in left:
        t, at, text = r[1], 0, ""
        for a, k, b in all_secrets(t):
            if b > at:
                text += (t[at:a] + "[secret]") if a >= at else ""
                at = b
        want[r[0]] = text + t[at:]
    library = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(want)
    assert all(r.ids == library.encode(r.text) and r.n_ids == len(r.ids) and r.n_chars == len(r.text) for r in got)
    assert not any(4000 <= d < 5000 or 3000 <= d < 4000 for d in want) and sum("[secret]" in t for t in want.values()) == 5


def test_last_stage_decodes_every_document(spark):
    docs = spark.createDataFrame([(1, "a password [secret]\n  kept "), (2, "the mark \u2581 itself"), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.round_trip for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
