"""Exact substring removal with suffix arrays over shards.

A window of ``size`` bytes selects the smallest of its grams by hash; equal
windows select equal grams at equal places. The windows of a text that select
one gram form a context. Contexts are sharded by their gram's hash, so all
copies of a window meet in one shard, whose suffix array and permuted common
prefixes tell which windows repeat. Grams that occur once need no shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paperweave.llm.common import slices, stored, stored_in_buckets, texts
from paperweave.llm.suffix_arrays import repeated_windows

GRAM = 32
SHARD = 1 << 19              # bytes of contexts that one suffix array covers, and one gram's more
HOT = 4096                   # occurrences of a gram from which on its windows are dealt out one by one
GROUP_BYTES = 4 << 20        # of texts that a task holds at once, apart from a longer single text
PLACE = 31                   # bits of a place in a run of texts
FLAGS = "home int, gram long, content long, flag binary"
CUT = "sha binary, n_removed long, n_spans long, kept_sha256 string"
KINDS = {"home": pa.int32(), "gram": pa.int64(), "content": pa.int64(), "flag": pa.binary(), "n": pa.int64(),
         "hot": pa.bool_(), "data": pa.binary(), "sha": pa.binary(), "n_removed": pa.int64(), "n_spans": pa.int64(),
         "kept_sha256": pa.string(), "kept": pa.binary()}


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from each place on."""
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        step, c = 1, np.uint64(0xD6E8FEB86659FD93)
        while step < GRAM:
            h = h[:-step] * c + h[step:]
            h ^= h >> np.uint64(32)
            c = c * c | np.uint64(1)
            step *= 2
        return h


def _run_contexts(docs: Sequence[bytes], size: int) -> tuple[np.ndarray, ...]:
    lengths = np.array([len(d) for d in docs], np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    data = np.frombuffer(b"".join(docs), np.uint8)
    if not len(data) or lengths.max() < size:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    if len(data) >= 1 << PLACE:
        raise ValueError("a text is too long")
    h = gram_hashes(data)
    least = (h >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(h), dtype=np.uint64)
    width, step = size - GRAM + 1, 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[:len(least) - (width - step)], least[width - step:])
    long = lengths >= size
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - size + 1, -1)
    window = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    gram = (least[window] & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (window[1:] != window[:-1] + 1)]))
    lo, hi = window[first], window[np.append(first[1:], len(window)) - 1]
    doc = np.searchsorted(ends, lo, side="right")
    return h[gram[first]].view(np.int64), doc, lo - starts[doc], hi - starts[doc]


def contexts(docs: Sequence[bytes], size: int, run_bytes: int = 1 << 20) -> tuple[np.ndarray, ...]:
    """Gram hash, text, first and last window start of every context. Each
    window (start of ``size`` bytes) of each text is in one context. Texts are
    taken in runs of about a megabyte, which the caches hold."""
    out, at = [], 0
    while at < len(docs):
        end, n = at + 1, len(docs[at])
        while end < len(docs) and n + len(docs[end]) <= run_bytes:
            n += len(docs[end])
            end += 1
        gram, doc, lo, hi = _run_contexts(docs[at:end], size)
        out.append((gram, doc + at, lo, hi))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else _run_contexts([], size)


def _hashes(parts: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(p) for p in parts], np.uint64).view(np.int64)


def _arrow(rows: list[tuple], names: Sequence[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[n]) for c, n in zip(columns, names, strict=True)], names=list(names))


def _once_per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop texts that the task has had, so that copies are few in the shuffle."""
    seen: set[bytes] = set()
    for batch in batches:
        new = []
        for sha in batch.column("sha").to_pylist():
            new.append(sha not in seen)
            seen.add(sha)
        yield batch.filter(pa.array(new, pa.bool_()))


def _grams(size: int):
    """Task function: the grams of each home's contexts, with their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                gram, doc, _, _ = contexts(texts(part), size)
                home = part.column("home").to_numpy()[doc]
                order = np.lexsort((gram, home))
                gram, home = gram[order], home[order]
                first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (home[1:] != home[:-1])])[:len(gram)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(home[first], pa.int32()), pa.array(gram[first]), pa.array(np.diff(np.append(first, len(gram))))],
                    names=["home", "gram", "n"])

    return run


def _gather(size: int):
    """Cogroup function: a home's texts and its repeated grams in; its distinct
    contexts, and of hot grams its distinct windows, out."""
    def run(homes: pa.Table, grams: pa.Table) -> pa.Table:
        docs = texts(homes)
        wanted = dict(zip(grams.column("gram").to_pylist(), grams.column("hot").to_pylist(), strict=True))
        home = homes.column("home")[0].as_py() if docs else 0
        gram, doc, lo, hi = contexts(docs, size)
        own = np.flatnonzero(np.isin(gram, np.fromiter(wanted, np.int64, len(wanted))))
        data = [docs[d][a:b + size] for d, a, b in zip(doc[own].tolist(), lo[own].tolist(), hi[own].tolist(), strict=True)]
        seen: dict[tuple[int, int], list] = {}
        for g, c, x in zip(gram[own].tolist(), _hashes(data).tolist(), data, strict=True):
            seen.setdefault((g, c), [x, 0])[1] += 1
        rows, windows = [], {}
        for (g, c), (x, n) in seen.items():
            if wanted[g]:
                for w in _hashes([x[i:i + size] for i in range(len(x) - size + 1)]).tolist():
                    windows[g, w] = windows.get((g, w), 0) + n
            else:
                rows.append((home, g, c, n, False, x))
        rows += [(home, g, w, n, True, None) for (g, w), n in windows.items()]
        return pa.Table.from_batches([_arrow(rows, ("home", "gram", "content", "n", "hot", "data"))])

    return run


def _search_shards(size: int):
    """Task function: contexts sorted by gram and content in; for each home of
    a context with repeated windows their flags out. A group is the distinct
    contexts of a gram: content, bytes, occurrences, homes."""
    def tell(out, gram, context, flag):
        if flag.any():
            packed = np.packbits(flag).tobytes()
            out.extend((home, gram, context[0], packed) for home in context[3])

    def solve(groups, out):
        # One suffix array over all groups: equal windows select equal grams, so they are in one group.
        flags = iter(repeated_windows([c[1] for _, group in groups for c in group], size) if groups else ())
        for gram, group in groups:
            for c in group:
                tell(out, gram, c, next(flags) | (c[2] > 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, held, group, last = [], 0, [], None

        def close(out):
            nonlocal held
            if len(group) > 1:
                groups.append((last, group))
                held += sum(len(c[1]) for c in group)
            elif group:                                          # a single content: repeated if it occurs again
                tell(out, last, group[0], np.full(len(group[0][1]) - size + 1, group[0][2] > 1))

        for batch in batches:
            out = []
            for gram, content, home, n, data in zip(*(batch.column(c).to_pylist() for c in
                                                      ("gram", "content", "home", "n", "data")), strict=True):
                if gram != last:
                    close(out)
                    if held >= SHARD:
                        solve(groups, out)
                        groups, held = [], 0
                    group, last = [], gram
                if group and group[-1][0] == content:
                    group[-1][2] += n
                    group[-1][3].append(home)
                else:
                    group.append([content, data, n, [home]])
            yield _arrow(out, ("home", "gram", "content", "flag"))
        out = []
        close(out)
        solve(groups, out)
        yield _arrow(out, ("home", "gram", "content", "flag"))

    return run


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of n bytes are in a window of ``size`` bytes at one of the starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge[:n]) > 0


def _cut(size: int, with_text: bool):
    """Cogroup function: a home's texts and the flags of its contexts in; what
    is removed from each text that loses something out."""
    names = ("sha", "n_removed", "n_spans", "kept_sha256", "kept")[:5 if with_text else 4]

    def run(homes: pa.Table, flags: pa.Table) -> pa.Table:
        docs, shas = texts(homes), homes.column("sha").to_pylist()
        packed, again = {}, set()
        for g, c, f in zip(*(flags.column(x).to_pylist() for x in ("gram", "content", "flag")), strict=True):
            if g is None:
                again.add(f)
            else:
                packed[g, c] = f
        hot = {g for (g, _), f in packed.items() if f is None}
        starts = [[np.arange(len(x) - size + 1)] if sha in again else [] for sha, x in zip(shas, docs, strict=True)]
        gram, doc, lo, hi = contexts(docs, size)
        own = np.flatnonzero(np.isin(gram, np.array(sorted({g for g, _ in packed}), np.int64)))
        for g, d, a, b in zip(gram[own].tolist(), doc[own].tolist(), lo[own].tolist(), hi[own].tolist(), strict=True):
            if shas[d] in again:
                continue
            x = docs[d][a:b + size]
            if g in hot:
                windows = _hashes([x[i:i + size] for i in range(b - a + 1)]).tolist()
                starts[d].append(np.array([a + i for i, w in enumerate(windows) if (g, w) in packed], np.int64))
            elif (f := packed.get((g, int(_hashes([x])[0])))) is not None:
                starts[d].append(np.flatnonzero(np.unpackbits(np.frombuffer(f, np.uint8), count=b - a + 1)) + a)
        rows = []
        for sha, x, found in zip(shas, docs, starts, strict=True):
            if found and len(at := np.concatenate(found)):
                gone = covered(len(x), at, size)
                spans = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]])))
                kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
                rows.append((sha, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)[:len(names)])
        return pa.Table.from_batches([_arrow(rows, names)])

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 200,
                   with_text: bool = False) -> DataFrame:
    """Per row (repeated rows included): ``id_col``, ``n_bytes``, ``n_removed``,
    ``n_spans`` (maximal removed runs) and ``kept_sha256`` of the bytes that are
    left; ``with_text`` adds these as ``kept`` (binary: a cut can split a
    character). A byte is removed if ``size`` bytes that cover it also start
    elsewhere, in the same text or another; all are judged on the input.

    Equal texts are one text with a count. These are stored once, dealt to
    homes of a few megabytes and bucketed by home, so later steps read them in
    place. Grams are counted per home before the shuffle, contexts are sent
    once per home and flags come back once per home: a passage that a third of
    all texts share is one row per home on the way. A gram with more than HOT
    occurrences, whose contexts could overfill a shard, has its windows dealt
    out by their 64-bit hash beside the gram's instead: these windows, and the
    contexts of a gram, are taken for equal by 128 bits of hashes, not by their bytes.

    Null or empty texts, and those below ``size`` bytes, lose nothing. Null ids
    stay null, other columns are not read, an empty table gives no rows.
    """
    if size < GRAM:
        raise ValueError(f"size must be {GRAM} at least")
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumns(
        {"n_bytes": F.octet_length("text").cast("long"), "sha": F.unhex(F.sha2("text", 256))})
    rows = stored(named.select("id", "n_bytes", "sha"), "rows")
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    homes = max(8 * buckets, -(-total // GROUP_BYTES))
    home = F.pmod(F.xxhash64("sha"), F.lit(homes)).cast("int")
    long = named.where(F.col("n_bytes") >= size).select("sha", "text")
    once = long.mapInArrow(_once_per_task, long.schema).select(home.alias("home"), "sha", "text")
    unique = stored_in_buckets(once.repartition(buckets, "home").groupBy("home", "sha").agg(F.first("text").alias("text")),
                               "texts", buckets, "home")

    counts = stored(unique.select("home", "text").mapInArrow(_grams(size), "home int, gram long, n long"), "grams")
    # totals by partial sums, then a join: a gram of every home is one key that the join can split
    totals = counts.groupBy("gram").agg(F.sum("n").alias("total")).where("total > 1")
    repeated = counts.select("home", "gram").join(totals, "gram").select("home", "gram", (F.col("total") > HOT).alias("hot"))
    found = stored(unique.groupBy("home").cogroup(repeated.groupBy("home")).applyInArrow(
        _gather(size), "home int, gram long, content long, n long, hot boolean, data binary"), "contexts")
    cold = (found.where("not hot").repartition("gram").sortWithinPartitions("gram", "content")
            .mapInArrow(_search_shards(size), FLAGS))
    hot = (found.where("hot").withColumn("total", F.sum("n").over(W.partitionBy("gram", "content"))).where("total > 1")
           .select("home", "gram", "content", F.lit(None).cast("binary").alias("flag")))
    # Texts that occur again repeat as a whole: told to their home by a row without a gram.
    again = rows.where(F.col("n_bytes") >= size).groupBy("sha").agg(F.count("*").alias("n")).where("n > 1").select(
        home.alias("home"), F.lit(None).cast("long").alias("gram"), F.lit(None).cast("long").alias("content"),
        F.col("sha").alias("flag"))
    cut = unique.groupBy("home").cogroup(cold.unionByName(hot).unionByName(again).groupBy("home")).applyInArrow(
        _cut(size, with_text), CUT + ", kept binary" * with_text)
    zero = F.lit(0).cast("long")
    return (named if with_text else rows).join(cut, "sha", "left").select(
        F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"),
        *[F.coalesce("kept", F.encode("text", "UTF-8")).alias("kept")] * with_text)
