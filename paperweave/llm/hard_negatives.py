"""Hard-negative mining by segment summaries.

Every vector of whole numbers is cut into segments; of each, the mean and the
deviation (root of the summed squared differences from the mean) are stored.
For a pair of segments of length n, the inner product lies within
n * mean * mean' +- deviation * deviation', so the sums of these over a vector's
segments bound the score. Tasks refine the bounds level by level (one segment,
4, then 16), keep the pairs that can still reach an answer, and score those
exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.llm.common import stored
from paperweave.operators.topn import top_n

SEGMENTS = (1, 4, 16)        # of a vector, from coarse to fine
ANCHOR_BYTES = 16 << 20      # of the anchors that are broadcast at once
CELLS = 1 << 21              # pairs that a task looks at at once
EXACT = float(1 << 53)       # below it, sums of doubles are whole numbers without error
MOST = np.int64((1 << 63) - 1)


def cuts(dim: int, segments: int) -> np.ndarray:
    """Starts of the segments of a vector, and its end; no segment is empty."""
    return np.unique(np.linspace(0, dim, min(segments, dim) + 1).astype(np.int64)) if dim else np.zeros(1, np.int64)


def summaries(vectors: np.ndarray) -> np.ndarray:
    """For each level the segments' means, then their deviations, side by side."""
    parts = []
    for segments in SEGMENTS:
        at = cuts(vectors.shape[1], segments)
        n = np.diff(at)
        if not len(n):
            continue
        mean = np.add.reduceat(vectors, at[:-1], axis=1) / n
        off = vectors - np.repeat(mean, n, axis=1)
        parts += [mean, np.sqrt(np.add.reduceat(off * off, at[:-1], axis=1))]
    return np.concatenate(parts, axis=1) if parts else np.zeros((len(vectors), 0))


class Rows(NamedTuple):
    """Vectors of one length."""
    row: np.ndarray
    id: np.ndarray
    unnamed: np.ndarray       # whose id is null
    label: np.ndarray
    vectors: np.ndarray
    summary: np.ndarray

    def take(self, at) -> Rows:
        return Rows(*[c[at] for c in self])


def _matrix(lists, rows: np.ndarray, dim: int) -> np.ndarray:
    """The listed rows, all of this length, of a list column without nulls."""
    start = lists.offsets.to_numpy()[rows]
    return lists.values.to_numpy(zero_copy_only=False)[start[:, None] + np.arange(dim)].astype(np.float64)


def rows_of(table: pa.Table | pa.RecordBatch) -> dict[int, Rows]:
    """By vector length."""
    column = lambda c: (x.combine_chunks() if isinstance(x := table.column(c), pa.ChunkedArray) else x)
    vectors, summary, ids = column("vector"), column("summary"), column("id")
    dims, sizes = np.diff(vectors.offsets.to_numpy()), np.diff(summary.offsets.to_numpy())
    out = {}
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        take = lambda c: c.take(pa.array(at)).to_numpy(zero_copy_only=False)  # noqa: E731, B023
        out[dim] = Rows(take(column("row")), take(ids.fill_null(0)).astype(np.int64), take(ids.is_null()).astype(bool),
                        take(column("label")), _matrix(vectors, at, dim), _matrix(summary, at, int(sizes[at[0]])))
    return out


def _lists(sizes: np.ndarray, flat: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))


def whole_vectors(batch: pa.RecordBatch, scale: float) -> pa.RecordBatch:
    """The rows that take part: ``vector`` becomes floor(scale * x), with its summary."""
    lists = batch.column("vector")
    if lists.null_count:
        batch = batch.filter(lists.is_valid())
        lists = batch.column("vector")
    n = len(lists)
    offsets = lists.offsets.to_numpy() if n else np.zeros(1, np.int64)
    sizes, flat = np.diff(offsets), np.zeros(0)
    if n:
        flat = np.floor(lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]].astype(np.float64) * scale)
    owner, bad = np.repeat(np.arange(n), sizes), np.zeros(n, bool)
    bad[owner[~np.isfinite(flat)]] = True
    keep, flat, sizes = np.flatnonzero(~bad), flat[~bad[owner]], sizes[~bad]
    if (np.abs(flat) >= 2.0 ** 62).any():
        raise OverflowError("a component is beyond a long")
    starts = np.cumsum(sizes) - sizes
    of = {dim: 2 * sum(len(cuts(dim, s)) - 1 for s in SEGMENTS) for dim in np.unique(sizes).tolist()}
    held = np.array([of[d] for d in sizes.tolist()], np.int64)
    at, summary = np.cumsum(held) - held, np.zeros(held.sum(), np.float32)
    for dim, width in of.items():
        mine = np.flatnonzero(sizes == dim)
        summary[at[mine][:, None] + np.arange(width)] = summaries(flat[starts[mine][:, None] + np.arange(dim)])
    kept = [batch.column(c).take(pa.array(keep)) for c in ("row", "id", "label", "anchor")]
    return pa.RecordBatch.from_arrays([*kept, _lists(sizes, flat.astype(np.int64)), _lists(held, summary)],
                                      names=["row", "id", "label", "anchor", "vector", "summary"])


def exact_scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, without error."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0))
    if most < EXACT:
        return a @ x.T
    if most >= 2.0 ** 63:
        raise OverflowError("a score is beyond a long")
    return a.astype(np.int64) @ x.astype(np.int64).T


def candidates(anchors: Rows, x: Rows, pairs: np.ndarray, least: np.ndarray, most: np.ndarray):
    """Of the ``pairs`` (a matrix of flags), those whose exact score is from
    ``least`` to ``most`` of their anchor: the numbers of the anchors and rows left,
    their scores and flags as matrices, and how many pairs were scored. Bounds of ever
    finer segments drop pairs before, and anchors and rows without any."""
    who, rows = np.arange(len(anchors.row)), np.arange(len(x.row))
    first, alive = 0, pairs
    slack = 0.5 + 1e-5 * np.linalg.norm(anchors.vectors, axis=1)[:, None] * np.linalg.norm(x.vectors, axis=1).max(initial=0)
    for segments in SEGMENTS:
        n = np.diff(cuts(x.vectors.shape[1], segments))
        some_who, some_rows = alive.any(axis=1), alive.any(axis=0)
        who, rows, alive = who[some_who], rows[some_rows], alive[np.ix_(some_who, some_rows)]
        if not alive.size:
            break
        mean, dev = slice(first, first + len(n)), slice(first + len(n), first + 2 * len(n))
        first += 2 * len(n)
        centre = (anchors.summary[who, mean] * n) @ x.summary[rows, mean].T
        spread = anchors.summary[who, dev] @ x.summary[rows, dev].T + slack[who]
        alive = alive & (centre + spread >= least[who, None]) & (centre - spread <= most[who, None])
    some_who, some_rows = alive.any(axis=1), alive.any(axis=0)
    who, rows, alive = who[some_who], rows[some_rows], alive[np.ix_(some_who, some_rows)]
    score, scored = exact_scores(anchors.vectors[who], x.vectors[rows]), int(alive.sum())
    return who, rows, score, alive & (score >= least[who, None]) & (score <= most[who, None]), scored


class Wanted(NamedTuple):
    """One list per request: which anchor, how it scores, and how many."""
    anchor: np.ndarray        # number of the anchor; requests of an anchor lie side by side
    least: np.ndarray         # of the score, both included
    most: np.ndarray
    same_label: bool
    limit: int


class Search:
    """The best rows so far of each request, as ``(score, id, unnamed, row)`` arrays."""

    def __init__(self, anchors: Rows, wanted: Wanted):
        numbers = np.arange(len(anchors.row))
        starts, ends = (np.searchsorted(wanted.anchor, numbers, side=x) for x in ("left", "right"))
        asked = np.flatnonzero(ends > starts)
        self.anchors, self.wanted = anchors.take(asked), wanted
        self.starts, self.ends = starts[asked], ends[asked]
        self.floor = wanted.least.copy()          # of each request: least, or the last score of a full list
        self.high = np.maximum.reduceat(wanted.most, self.starts) if len(asked) else wanted.most
        self.best: list = [None] * len(wanted.anchor)
        self.pairs = self.scored = 0

    def add(self, part: Rows) -> None:
        if not len(self.starts):
            return
        step = max(64, CELLS // len(self.starts))
        for lo in range(0, len(part.row), step):
            x = part.take(slice(lo, lo + step))
            same = self.anchors.label[:, None] == x.label[None, :]
            pairs = (same if self.wanted.same_label else ~same) & (self.anchors.row[:, None] != x.row[None, :])
            self.pairs += int(pairs.sum())
            who, rows, score, alive, scored = candidates(
                self.anchors, x, pairs, np.minimum.reduceat(self.floor, self.starts), self.high)
            self.scored += scored
            for i, w in enumerate(who.tolist()):
                self._keep(w, x, rows[alive[i]], score[i, alive[i]].astype(np.int64))

    def _keep(self, w: int, x: Rows, rows: np.ndarray, score: np.ndarray) -> None:
        """Merge the scored rows of one anchor into the lists of its requests."""
        order = np.lexsort((x.row[rows], x.id[rows], x.unnamed[rows], -score))
        rows, score = rows[order], score[order]
        for q in range(self.starts[w], self.ends[w]):
            first = np.searchsorted(-score, -self.wanted.most[q])
            last = min(first + self.wanted.limit, np.searchsorted(-score, -self.floor[q], side="right"))
            if last <= first:
                continue
            some = rows[first:last]
            new = (score[first:last], x.id[some], x.unnamed[some], x.row[some])
            if self.best[q] is not None:
                new = tuple(map(np.concatenate, zip(self.best[q], new, strict=True)))
                order = np.lexsort((new[3], new[1], new[2], -new[0]))[:self.wanted.limit]
                new = tuple(c[order] for c in new)
            self.best[q] = new
            if len(new[0]) == self.wanted.limit:
                self.floor[q] = max(self.floor[q], new[0][-1])

    def found(self) -> tuple | None:
        """``(request, score, id, unnamed, row)`` arrays of all lists."""
        some = [(np.full(len(b[0]), q), *b) for q, b in enumerate(self.best) if b is not None]
        return tuple(map(np.concatenate, zip(*some, strict=True))) if some else None


FOUND = "request long, score long, id long, row long"


def _search_task(sent):
    """Task function: local answers of the broadcast requests, vector length by length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {dim: (request, Search(Rows(*anchors), Wanted(*wanted))) for dim, (anchors, request, wanted) in sent.value.items()}
        for batch in batches:
            for dim, rows in rows_of(batch).items():
                if dim in searches:
                    searches[dim][1].add(rows)
        for request, search in searches.values():
            got = search.found()
            if got is not None:
                q, score, ids, unnamed, row = got
                yield pa.RecordBatch.from_arrays(
                    [pa.array(request[q]), pa.array(score), pa.array(ids, mask=unnamed), pa.array(row)],
                    names=["request", "score", "id", "row"])

    return run


def hard_negatives(rows: DataFrame, anchors: Column, *, id_col: str = "vec_id", label_col: str = "label",
                   vector_col: str = "embedding", scale: float = 256.0, positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90) -> DataFrame:
    """For each row that ``anchors`` picks and each of its positives, the hard
    negatives: ``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``.

    A vector's components become floor(scale * x), and a score is the inner
    product of two such vectors. An anchor's positives are the ``positives``
    best other rows of its label; the negatives of a positive with score p are
    the ``negatives`` best rows of another label whose score s satisfies
    ``low * p <= 100 * s <= high * p``. Higher scores first, then smaller ids.

    All anchors meet all rows, in blocks: the anchors are broadcast in blocks of
    ANCHOR_BYTES, one after another, and the rows stream past, without a shuffle.
    A task emits its best few rows per request; a window over these picks the
    answers. Copies of a vector, however many, are ties that stay in the tasks.

    Rows with a null label, a null vector or a null, infinite or NaN component
    take no part; a null anchor flag counts as no. A null id stays null and comes
    last among ties; rows with equal ids, and repeated rows, each stand for
    themselves (the anchor row itself isn't its own partner). Vectors meet those
    of the same length only; two empty ones have score 0. Labels and ids are whole numbers. Scores beyond
    a long raise. An empty table, or one without anchors, gives no rows. Other columns are not read.
    """
    narrow = rows.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{label_col}`").cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("vector")).where("label is not null")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield whole_vectors(b, scale)

    table = stored(narrow.mapInArrow(prepare, "row long, id long, label long, anchor boolean, vector array<long>, summary array<float>"), "vectors")
    picked = table.where("anchor")
    size = picked.agg(F.coalesce(F.sum(8 * F.size("vector") + 8 * F.size("summary") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-size // ANCHOR_BYTES))
    out = [_block(table, rows_of(picked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).drop("anchor").toArrow()),
                  positives, negatives, low, high) for b in range(blocks)]
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def _best(table: DataFrame, anchors: dict[int, Rows], wanted: dict[int, tuple[np.ndarray, Wanted]], limit: int) -> DataFrame:
    """The answers of all requests: local ones of each task, then a window."""
    requests = {dim: (tuple(anchors[dim]), request, tuple(w)) for dim, (request, w) in wanted.items()}
    sent = table.sparkSession.sparkContext.broadcast(requests)
    found = table.select("row", "id", "label", "vector", "summary").mapInArrow(_search_task(sent), FOUND)
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row").asc()]
    return top_n(found, ["request"], order, limit, rank_col="rank")


def _block(table: DataFrame, anchors: dict[int, Rows], positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The answers of one block of anchors; the driver holds the block and its positives."""
    wanted, first = {}, 0
    for dim, a in anchors.items():
        n = len(a.row)
        wanted[dim] = (np.arange(first, first + n), Wanted(np.arange(n), np.full(n, -MOST), np.full(n, MOST), True, positives))
        first += n
    got = _best(table, anchors, wanted, positives).orderBy("request", "rank").toArrow()
    number, score = got.column("request").to_numpy(), got.column("score").to_pylist()
    within = lambda s: max(-int(MOST), min(int(MOST), s))
    least = np.array([within(-(-low * p // 100)) for p in score], np.int64)
    most = np.array([within(high * p // 100) for p in score], np.int64)
    asked, first = {}, 0
    for dim, a in anchors.items():
        at = np.flatnonzero((number >= first) & (number < first + len(a.row)))
        asked[dim] = (at, Wanted(number[at] - first, least[at], most[at], False, negatives))
        first += len(a.row)
    ids = np.concatenate([a.id for a in anchors.values()] or [np.zeros(0, np.int64)])
    unnamed = np.concatenate([a.unnamed for a in anchors.values()] or [np.zeros(0, bool)])
    pairs = table.sparkSession.createDataFrame(pa.table({
        "request": pa.array(np.arange(len(number))), "anchor_id": pa.array(ids[number], mask=unnamed[number]),
        "positive_id": got.column("id"), "positive_score": got.column("score")}))
    best = _best(table, anchors, asked, negatives)
    return stored(best.join(F.broadcast(pairs), "request").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
