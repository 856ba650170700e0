"""Quality rules: fixed base rules, then robust multivariate outliers.

Each document gives a vector of transformed text statistics. A minimum-
covariance-determinant estimate (MCD) of every language and source describes
what is usual there; a document far from it by Mahalanobis distance is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from paperweave.llm.common import gathered, slices, stored, texts

LEAST_WORDS = 20             # fixed values of the base rules
REPEAT_PERCENT = 30
WINDOW = 8
SPACE = bytes([0x20, *range(0x09, 0x0E)])
SYMBOLS = b"#*$%&|<>"
PUNCTUATION = b".,;:!?"

UNIT = 1024                  # statistics are whole multiples of 1 / UNIT, so their sums are exact in any order
FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "punctuation", "variety")
#: Least standard deviation: a statistic that is constant in a group must not reject its smallest change;
#: half of all lines duplicated (a root of the share of 0.7) is rejected even by itself.
FLOOR = (0.25, 0.05, 0.1, 0.09, 0.1, 0.05, 0.1, 0.1)
P = len(FEATURES)
SHARE = 0.75                 # of a group that the MCD subset holds
STEPS = 8                    # concentration steps
FIRST_STEPS = 3              # of these, from all starts; the rest from the best of them
LEAST_GROUP = 50             # smaller groups are pooled by language, then altogether
TAIL = 1e-8                  # of a normal group that the cut-off rejects
BROADCAST_GROUPS = 50_000    # of some 50 numbers each: about 20 MB
TASK_GROUPS = 1024           # whose estimates one task makes and one file holds
BINS = 16                    # of squared distances in each doubling, to find the subset's bound
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals",
          "n_letters", "n_punctuation", "n_distinct")


def _is(chars: bytes) -> np.ndarray:
    flag = np.zeros(256, bool)
    flag[list(chars)] = True
    return flag


def repeated_words(ids: np.ndarray, doc: np.ndarray, n_docs: int, window: int = WINDOW) -> np.ndarray:
    """Per document the words in windows that occur twice or more in it. Windows
    are sorted by a hash and neighbours compared word by word."""
    n = len(ids) - window + 1
    if n <= 0:
        return np.zeros(n_docs, np.int64)
    with np.errstate(over="ignore"):
        mix = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mix = (mix ^ (mix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        key = np.zeros(n, np.uint64)
        for k in range(window):
            key = key * np.uint64(0x100000001B3) + mix[k:k + n]
        key = (key ^ (key >> np.uint64(31))) + doc[:n].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    whole = np.flatnonzero(doc[:n] == doc[window - 1:])
    order = whole[np.argsort(key[whole], kind="stable")]
    near = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    a, b = order[near], order[near + 1]
    same = doc[a] == doc[b]
    for k in range(window):
        same &= ids[a + k] == ids[b + k]
    edge = np.zeros(len(ids) + 1, np.int64)
    hit = np.unique(np.concatenate([a[same], b[same]]))
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n_docs)


def count_texts(rows: Sequence[bytes]) -> dict[str, np.ndarray]:
    """``COUNTS`` of each text. Words are runs of other bytes than SPACE."""
    n = len(rows)
    buf = b"\n".join(rows)
    data = np.frombuffer(buf, np.uint8)
    sizes = np.array([len(r) for r in rows], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes

    def per_doc(flag: np.ndarray) -> np.ndarray:
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(flag)])
        return upto[ends] - upto[starts]

    gap = _is(SPACE)[data]
    out = {"word_chars": per_doc(~gap & ((data & 0xC0) != 0x80)), "n_symbols": per_doc(_is(SYMBOLS)[data]),
           "n_lines": per_doc(data == 10) + 1, "n_punctuation": per_doc(_is(PUNCTUATION)[data]),
           "n_capitals": per_doc((data >= 65) & (data <= 90))}
    out["n_letters"] = out["n_capitals"] + per_doc((data >= 97) & (data <= 122))
    begins = ~gap
    begins[1:] &= gap[:-1]
    out["n_words"] = per_doc(begins)
    words = buf.split()
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    doc = np.repeat(np.arange(n), out["n_words"])
    out["n_repeat_words"] = repeated_words(ids, doc, n)
    bounds = np.concatenate([[0], np.cumsum(out["n_words"])]).tolist()
    out["n_distinct"] = np.array([len(set(words[a:b])) for a, b in zip(bounds, bounds[1:])], np.int64)
    dup = []
    for r in rows:
        lines = [x for x in r.split(b"\n") if x.strip()]
        dup.append(len(lines) - len(set(lines)))
    out["n_dup_lines"] = np.array(dup, np.int64)
    return out


def with_counts(docs: DataFrame, text_col: str, carry: Sequence[str]) -> DataFrame:
    """The ``carry`` columns of every row, and its ``COUNTS`` (names with an
    underscore before them, so they can't clash with carried ones)."""
    renamed = docs.select(F.col(f"`{text_col}`").alias("_text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                got = count_texts(texts(part, "_text"))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(f"c{i}") for i in range(len(carry))], *[pa.array(got[c].astype(np.int64)) for c in COUNTS]],
                    names=[*[f"c{i}" for i in range(len(carry))], *[f"_{c}" for c in COUNTS]])

    schema = renamed.drop("_text").schema
    for c in COUNTS:
        schema = schema.add(f"_{c}", T.LongType())
    return renamed.mapInArrow(run, schema).withColumnsRenamed({f"c{i}": c for i, c in enumerate(carry)})


def _features() -> list[Column]:
    """The transformed statistics as whole multiples of 1 / UNIT: logarithms of
    sizes and square roots of shares, which evens out their variances."""
    c = lambda name: F.col(f"_{name}").cast("double")
    words = F.greatest(c("n_words"), F.lit(1.0))
    share = lambda a, b: F.sqrt(a / F.greatest(b, F.lit(1.0)))
    values = [F.log(words), F.log(F.greatest(c("word_chars"), F.lit(1.0)) / words), share(c("n_symbols"), words),
              share(c("n_dup_lines"), c("n_lines")), share(c("n_repeat_words"), words),
              share(c("n_capitals"), c("n_letters")), share(c("n_punctuation"), words),
              F.log(F.greatest(c("n_distinct"), F.lit(1.0)) / words)]
    return [F.round(v * UNIT).cast("long").alias(f"_x{i}") for i, v in enumerate(values)]


def base_failed() -> Column:
    return (F.col("_n_words") < LEAST_WORDS) | (100 * F.col("_n_repeat_words") > REPEAT_PERCENT * F.col("_n_words"))


def _group(lang: str, source: str) -> tuple[Column, Column]:
    """Keys of a language, and of a language and source; null is a value of its own."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-"))
    return key(lang), F.concat(key(lang), F.lit("\x01"), key(source))


def chi2_below(x: float, k: int) -> float:
    """Distribution function of chi-square with an even number of degrees."""
    term, total = 1.0, 0.0
    for j in range(k // 2):
        total += term
        term *= x / 2 / (j + 1)
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_below(mid, k) < p else (lo, mid)
    return hi


CUT = chi2_quantile(1 - TAIL, P)
MATRIX = [f"a{i}_{j}" for i in range(P) for j in range(i, P)]


def _distance() -> Column:
    """Squared Mahalanobis distance of the features from the joined estimate."""
    d = [F.col(f"_x{i}") / UNIT - F.col(f"m{i}") for i in range(P)]
    out = F.lit(0.0)
    for i in range(P):
        row = F.col(f"a{i}_{i}") * d[i]
        for j in range(i + 1, P):
            row = row + 2 * F.col(f"a{i}_{j}") * d[j]
        out = out + d[i] * row
    return F.greatest(out, F.lit(0.0))


def _moments() -> list[Column]:
    """Exact sums as longs: features and their products are bounded by the texts' bytes, so some 10^14 bytes of
    text would be needed to pass a long, which then fails the job."""
    return [F.count("*").alias("n"), *[F.sum(f"_x{i}").cast("double").alias(f"s{i}") for i in range(P)],
            *[F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).cast("double").alias(f"q{i}_{j}")
              for i in range(P) for j in range(i, P)]]


def _schema(rows: DataFrame) -> str:
    """Of estimates; the groups' keys are those of the rows."""
    return f"_g {rows.schema['_g'].dataType.simpleString()}, _s int, n long, det double, " + ", ".join(
        f"{c} double" for c in [*[f"m{i}" for i in range(P)], *MATRIX])


def _of(rows: DataFrame) -> list[str]:
    """Key columns of an estimate. Numbered groups have one long: a broadcast table by it has the size of its
    rows, by other keys it takes a page of some 16 MB in each executor, and there is one for each step."""
    return ["_gs"] if rows.schema["_g"].dataType == T.LongType() else ["_g", "_s"]


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_gs", F.col("_g") * 4 + F.col("_s")) if _of(rows) == ["_gs"] else rows


def _small(table: DataFrame, groups: int) -> DataFrame:
    """One row per group, broadcast up to BROADCAST_GROUPS of them; beyond
    that, joined by group, and AQE splits a hot one."""
    return F.broadcast(table) if groups <= BROADCAST_GROUPS else table


def _few(table: DataFrame, groups: int) -> DataFrame:
    """One row per group in a task for each TASK_GROUPS of them, not in every shuffle partition: most of these
    would be empty, yet each calls Python, and each file written makes its executor start processes (chmod)."""
    return table.repartition(1 + groups // TASK_GROUPS)


def _invert(share: float):
    """From moments to the centre, inverse covariance and logarithm of the determinant; ``share``
    is the part of a normal group that gave the moments, for the consistency factor."""
    factor = share / chi2_below(chi2_quantile(share, P), P + 2) if share < 1 else 1.0
    pairs = [(i, j) for i in range(P) for j in range(i, P)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                mean = np.array([r[f"s{i}"] for i in range(P)]) / r["n"]
                cov = np.zeros((P, P))
                for i, j in pairs:
                    cov[i, j] = cov[j, i] = (r[f"q{i}_{j}"] / r["n"] - mean[i] * mean[j]) / UNIT ** 2
                cov = cov * factor + np.diag(np.square(FLOOR))
                inv = np.linalg.inv(cov)
                out.append([r["_g"], r["_s"], r["n"], np.linalg.slogdet(cov)[1], *(mean / UNIT), *[inv[i, j] for i, j in pairs]])
            yield pd.DataFrame(out, columns=["_g", "_s", "n", "det", *[f"m{i}" for i in range(P)], *MATRIX])

    return run


def _diagonal(number: int, centre: Sequence[Column], deviation: Sequence[Column]) -> list[Column]:
    """The columns of a start: a centre, and no covariances."""
    return ["_g", F.lit(number).alias("_s"), "n", F.lit(0.0).alias("det"), *[(c / UNIT).alias(f"m{i}") for i, c in enumerate(centre)],
            *[(1 / (F.pow(deviation[i] / UNIT, 2) + FLOOR[i] ** 2) if i == j else F.lit(0.0)).alias(f"a{i}_{j}")
              for i in range(P) for j in range(i, P)]]


def _concentrated(rows: DataFrame, est: DataFrame, sizes: DataFrame, groups: int) -> DataFrame:
    """A concentration step of each estimate: the SHARE of its group that is nearest to it, estimated again."""
    of = ["_g", "_s"]
    far = rows.join(_small(est.drop("n", "det"), groups), "_g").withColumn("_bin", F.floor(BINS * F.log2(_distance() + 1e-6)).cast("int"))
    bins = far.groupBy(*of, "_bin").agg(F.count("*").alias("k")).join(_small(sizes, groups), "_g")
    upto = F.sum("k").over(W.partitionBy(*of).orderBy("_bin"))
    bound = (bins.withColumn("upto", upto).where(F.col("upto") >= SHARE * F.col("_size"))
             .groupBy(*of).agg(F.min("_bin").alias("_last")))
    near = _keyed(far).join(_small(_keyed(bound).select(*_of(bound), "_last"), groups), _of(far)).where("_bin <= _last")
    return stored(_few(near.groupBy(*of).agg(*_moments()), groups).mapInPandas(_invert(SHARE), _schema(rows)), "estimate")


def estimates(rows: DataFrame, most: int | None = None) -> DataFrame:
    """MCD estimate of each group ``_g`` (numbered or named; ``most`` of them, if known) of the feature rows. Three deterministic
    starts: medians with median deviations, mid-hinges with interquartile ranges, and
    the moments of all rows. Each is concentrated a few times, the one of the least determinant
    goes on; last, one reweighting by all that are near. A step is two aggregations by group and start,
    combined in the tasks, so a hot group is no larger than another one in the
    shuffle. The bound of the nearest share is read off counts of distance bins. ``rows`` is a stored table."""
    rows = gathered(rows, rows.count())
    quartiles = [F.percentile(f"_x{i}", F.lit([0.25, 0.5, 0.75])).alias(f"p{i}") for i in range(P)]
    # The values are rounded to 1 / UNIT: a median's buffer holds some ten thousand of them at most.
    centre = rows.groupBy("_g").agg(F.count("*").alias("n"), *quartiles)
    centre = stored(centre if most is None else _few(centre, most), "medians")
    groups = centre.count()
    centre = gathered(centre, groups)
    at = lambda i, k: F.col(f"p{i}")[k]
    spread = rows.join(_small(centre, groups), "_g").groupBy("_g").agg(
        *[F.percentile(F.abs(F.col(f"_x{i}") - at(i, 1)), 0.5).alias(f"d{i}") for i in range(P)])
    medians = centre.join(spread, "_g").select(_diagonal(0, [at(i, 1) for i in range(P)], [1.4826 * F.col(f"d{i}") for i in range(P)]))
    hinges = centre.select(_diagonal(1, [(at(i, 0) + at(i, 2)) / 2 for i in range(P)], [(at(i, 2) - at(i, 0)) / 1.349 for i in range(P)]))
    moments = _few(rows.groupBy("_g", F.lit(2).alias("_s")).agg(*_moments()), groups).mapInPandas(_invert(1.0), _schema(rows))
    est = stored(_few(medians.unionByName(hinges).unionByName(moments), 3 * groups), "starts")
    sizes = centre.select("_g", F.col("n").alias("_size"))
    for step in range(STEPS):
        if step == FIRST_STEPS:
            names = [c for c in est.columns if c not in ("_g", "_s", "det")]
            best = gathered(est, 3 * groups).groupBy("_g").agg(F.min(F.struct("det", "_s", *names)).alias("b"))
            est = stored(_few(best.select("_g", "b.*"), groups), "best")
        est = _concentrated(rows, est, sizes, 3 * groups)
    near = rows.join(_small(est.drop("n", "det"), groups), "_g").where(_distance() <= chi2_quantile(0.975, P))
    return stored(_few(near.groupBy("_g", "_s").agg(*_moments()), groups).mapInPandas(_invert(0.975), _schema(rows)), "estimate").drop("_s", "det")


def _judged(docs: DataFrame, text_col: str, lang_col: str, source_col: str, carry: Sequence[str], store: bool) -> DataFrame:
    """The ``carry`` columns of every row, as ``_carry0`` and so on, with its
    counts, ``_failed``, ``_distance`` and ``_kept``. ``store``: the counts are
    written once with the carried columns; else they are made again for the verdicts, so that wide rows aren't written."""
    language, both = _group(lang_col, source_col)
    names = [f"_carry{i}" for i in range(len(carry))]
    wide = docs.select(F.col(f"`{text_col}`").alias("_t"), language.alias("_lang"), both.alias("_both"),
                       *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)])
    rows = with_counts(wide, "_t", [*names, "_lang", "_both"])
    rows = rows.select(*names, "_lang", "_both", *[f"_{c}" for c in COUNTS], *_features(), base_failed().alias("_failed"))
    features = [f"_x{i}" for i in range(P)]
    if store:
        rows = stored(rows, "counts")
    narrow = rows.where("not _failed").select("_lang", "_both", *features)
    if not store:
        counted = with_counts(wide.select("_t", "_lang", "_both"), "_t", ["_lang", "_both"])
        narrow = stored(counted.where(~base_failed()).select("_lang", "_both", *_features()), "features")
    narrow = gathered(narrow, narrow.count())
    pool = stored(_pools(narrow), "pools")
    pairs = pool.count()
    pool = gathered(pool, pairs)
    est = estimates(stored(narrow.join(_small(pool, pairs), ["_lang", "_both"]).drop("_lang", "_both"), "grouped"), pairs)
    table = pool.join(gathered(est.drop("n"), pairs), "_g", "left").drop("_g", "_lang").withColumnRenamed("_both", "_key")
    judged = rows.join(_small(table, pairs), F.col("_both") == F.col("_key"), "left").withColumn(
        "_distance", F.when(~F.col("_failed") & F.col("m0").isNotNull(), _distance()))
    kept = ~F.col("_failed") & (F.coalesce(F.col("_distance"), F.lit(0.0)) <= CUT)
    return judged.select(*names, *[f"_{c}" for c in COUNTS], "_failed", "_distance", kept.alias("_kept"))


def quality_verdicts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                     source_col: str = "source") -> DataFrame:
    """One row per document (repeated rows included): ``id_col``, ``n_words``,
    ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed``, ``distance`` (squared Mahalanobis; null if base_failed or
    without an estimate) and ``kept``.

    Estimates come from all documents that pass the base rules, by language and
    source; groups of fewer than LEAST_GROUP documents are pooled by language,
    then altogether; without that many the base rules alone decide. Only counts
    and features are stored and shuffled, never texts. Estimates are one row
    per group; AQE broadcasts them if they measure small, else joins by group
    and splits a hot one.

    Null or empty text has no words and fails the base rules. Null languages
    and sources are values of their own, null ids stay null. Other columns are
    not read. An empty table gives no rows.
    """
    rows = _judged(docs, text_col, lang_col, source_col, [id_col], store=True)
    return rows.select(F.col("_carry0").alias(id_col), *[F.col(f"_{c}").alias(c) for c in COUNTS[:5]], F.col("_failed").alias("base_failed"),
                       F.col("_distance").alias("distance"), F.col("_kept").alias("kept"))


def quality_filter(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns, that ``quality_verdicts`` keeps."""
    return _judged(docs, text_col, lang_col, source_col, docs.columns, store=False).where("_kept").select(
        *[F.col(f"_carry{i}").alias(c) for i, c in enumerate(docs.columns)])


def _pools(rows: DataFrame) -> DataFrame:
    """``(_lang, _both, _g)``: the number of the group that estimates each language and source."""
    sizes = stored(rows.groupBy("_lang", "_both").agg(F.count("*").alias("k")), "sizes")
    pairs = sizes.count()
    one = gathered(sizes, pairs).withColumn("_g", F.when(F.col("k") >= LEAST_GROUP, F.col("_both")).otherwise(F.col("_lang")))
    per = one.groupBy(F.col("_g").alias("g1")).agg(F.sum("k").alias("k1"))
    two = one.join(per, F.col("_g") == F.col("g1")).withColumn(
        "_g", F.when(F.col("k1") >= LEAST_GROUP, F.col("_g")).otherwise(F.lit("")))
    rest = two.groupBy(F.col("_g").alias("g2")).agg(F.sum("k").alias("k2"))
    # numbers must stay the same for all that read them
    rest = stored(_few(rest.where(F.col("k2") >= LEAST_GROUP), pairs).withColumn("_n", F.monotonically_increasing_id()), "groups")
    return _few(two.join(gathered(rest, pairs), F.col("_g") == F.col("g2")).select("_lang", "_both", F.col("_n").alias("_g")), pairs)
