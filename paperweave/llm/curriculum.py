"""Mixing sources to target weights by a curriculum that varies over time.
DataFrame functions only.

Every source has a schedule: its rate over the training time from 0 to 1, linear
between knots. The schedule's integral is the source's weight, which sets how
many words of it the mix takes; its integral up to a time, as a share, is the
part of these words due by then. A document starts at some word of its source's
stream (the stream runs through the source's documents in hash order, as often
as its target asks for); the inverse of the cumulative demand turns that into
the document's position in training, and a range sort by position gives the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.llm.common import stored, sums_before
from paperweave.operators.topn import checked_broadcast

Schedule = Sequence[tuple[float, float]]     # knots (time, rate)

#: Falling from 3/2 of the mean rate to a half of it, steady, and rising: the integrals are 5, 2 and 1.
SCHEDULES: tuple[Schedule, ...] = (((0.0, 7.5), (1.0, 2.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)))
CHUNK = 1 << 16              # copies of one repeated row that are numbered at once
WORD = r"[^\x20\x09-\x0D]+"


def demand(schedule: Schedule) -> list[float]:
    """The integral of the schedule up to each knot."""
    times, rates = zip(*schedule, strict=True)
    if times[0] != 0 or times[-1] != 1 or any(a >= b for a, b in zip(times, times[1:], strict=False)) or min(rates) < 0:
        raise ValueError("a schedule's times rise from 0 to 1, and its rates aren't negative")
    out = [0.0]
    for (t0, r0), (t1, r1) in zip(schedule, schedule[1:], strict=False):
        out.append(out[-1] + (r0 + r1) / 2 * (t1 - t0))
    if out[-1] <= 0:
        raise ValueError("a schedule's integral must be positive")
    return out


def time_of(share: Column, schedule: Schedule) -> Column:
    """When this share (0 to 1) of the schedule's demand is due: the inverse of its integral."""
    upto = demand(schedule)
    due = share * F.lit(upto[-1])
    out = None
    for k in reversed(range(len(schedule) - 1)):
        (t0, r0), (t1, r1) = schedule[k], schedule[k + 1]
        y = F.greatest(due - F.lit(upto[k]), F.lit(0.0))
        root = F.lit(r0) + F.sqrt(F.greatest(F.lit(r0 * r0) + F.lit(2 * (r1 - r0) / (t1 - t0)) * y, F.lit(0.0)))
        here = F.least(F.lit(t0) + F.when(y > 0, 2 * y / root).otherwise(F.lit(0.0)), F.lit(t1))
        out = here if out is None else F.when(due < F.lit(upto[k + 1]), here).otherwise(out)
    return out


def _by_kind(kind: Column, values: Sequence[Column]) -> Column:
    out = values[-1]
    for i in reversed(range(len(values) - 1)):
        out = F.when(kind == i, values[i]).otherwise(out)
    return out


def source_targets(sizes: DataFrame, schedules: Sequence[Schedule], budget: float, most: int) -> DataFrame:
    """``sizes`` (source, source_size; one row per source) with ``kind`` (its
    schedule, in turn by code point, null last) and ``target``.

    The budget is shared by weight; no source gets more than ``most`` times its
    size, and the rest is shared again among the others until none is above.
    Each turn is one aggregate of the table of sources, of which three numbers reach the driver."""
    one = sizes.withColumn("_one", F.lit(1).cast("long"))
    nth = sums_before(one, [], [F.col("source").asc_nulls_last()], {"_nth": "_one"})
    weight = _by_kind(F.col("kind"), [F.lit(demand(s)[-1]) for s in schedules])
    table = stored(nth.withColumn("kind", (F.col("_nth") % len(schedules)).cast("int"))
                   .withColumns({"_w": weight, "_cap": F.col("source_size") * most}).drop("_nth", "_one"), "sources")
    all_words, share, full = table.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        over = F.col("_w") * F.lit(share) > F.col("_cap")
        got = table.agg(F.count(F.when(over, 1)), F.sum(F.when(over, F.col("_cap"))), F.sum(F.when(~over, F.col("_w")))).first()
        if got[0] == full:
            break
        full = got[0]
        if not got[2]:
            break
        share = (budget * all_words - (got[1] or 0)) / got[2]
    due = F.col("_w") * F.lit(share)
    return table.select("source", "source_size", "kind", F.when(due > F.col("_cap"), F.col("_cap").cast("double")).otherwise(due).alias("target"))


def curriculum_mix(docs: DataFrame, *, schedules: Sequence[Schedule] = SCHEDULES, budget: float = 1.5, most: int = 2,
                   id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """One row per document (repeated rows included): ``id_col``, ``source_col``,
    ``text_crc32``, ``size`` (words), ``source_size``, ``target`` of the source in
    words, ``taken`` (words that the mix takes, repeats counted) and ``copies``, an
    array of at most ``most`` structs: ``epoch``, ``words`` of the copy that are taken,
    ``position`` (0 to 1) and ``sequence``, the copy's place in training (gapless from 0).

    The mix takes ``budget`` times all words. A source's stream is its documents in the order of a hash
    of their ids, again and again until the target (rounded to whole words) is
    reached; the document in which it ends is the only one of its source that is cut. So a source's taken words are its target,
    and reruns agree, whatever the partitions. See ``source_targets`` for weights and targets, ``training_order`` for the copies as rows.

    Equal rows are counted first and numbered one after another; running sums are taken in sorted ranges with
    offsets, so a source with a third of all rows spreads over tasks, and the table of sources may have any size.

    Null or empty text: size 0, no copies. A null source is a source, the last; a null id hashes like an empty one. Very long
    texts count whole. An empty table gives no rows. Other columns are not read; names of the inputs' columns don't clash with the results'.
    """
    narrow = docs.select(
        F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.size(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("crc"))
    narrow = narrow.withColumn("size", F.greatest("size", F.lit(0).cast("long")))
    rows = stored(narrow.groupBy("source", "id", "size", "crc").agg(F.count("*").alias("n"))
                  .withColumn("words", F.col("n") * F.col("size"))
                  .withColumn("hash", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))), "sizes")
    sources = stored(source_targets(rows.groupBy("source").agg(F.sum("words").alias("source_size")), schedules, budget, most), "targets")
    order = ["hash", "id", "size", "crc"]
    streamed = sums_before(rows, ["source"], [F.col(c).asc() for c in order], {"start": "words"})
    known = checked_broadcast(sources.withColumnRenamed("source", "_source"))
    numbered = (streamed.join(known, F.col("source").eqNullSafe(F.col("_source")))
                .withColumn("_c", F.explode(F.expr(f"sequence(0, (n - 1) div {CHUNK})")))
                .withColumn("_k", F.explode(F.expr(f"sequence(_c * {CHUNK}, least(n, (_c + 1) * {CHUNK}) - 1)")))
                .withColumn("start", F.col("start") + F.col("_k") * F.col("size")))
    total = F.floor(F.col("target") + 0.5)
    copies = []
    for epoch in range(most):
        at = F.col("start") + F.col("source_size") * epoch
        words = F.greatest(F.least(F.col("size"), total - at), F.lit(0)).cast("long")
        share = at.cast("double") / F.greatest(total, F.lit(1)).cast("double")
        copies.append(F.struct(F.lit(epoch).alias("epoch"), words.alias("words"),
                               _by_kind(F.col("kind"), [time_of(share, s) for s in schedules]).alias("position"), at.alias("at")))
    mixed = stored(numbered.select(
        F.monotonically_increasing_id().alias("row"), "source", "id", "crc", "size", "source_size", "target",
        F.filter(F.array(*copies), lambda c: c["words"] > 0).alias("copies")), "mixed")
    placed = training_order(mixed.select("row", "source", F.explode("copies").alias("c")).select("row", "source", "c.*"))
    found = placed.groupBy("row").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(
        F.struct("epoch", "words", "position", "sequence"))).alias("placed"))
    none = F.array().cast("array<struct<epoch:int,words:bigint,position:double,sequence:bigint>>")
    return mixed.drop("copies").join(found, "row", "left").select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("crc").alias("text_crc32"), "size", "source_size", "target",
        F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("placed", none).alias("copies"))


def training_order(copies: DataFrame) -> DataFrame:
    """``copies`` (with ``position``, ``source`` and ``at``, the copy's first word in its source's
    stream) range-sorted by position, with ``sequence``, gapless from 0. Of equal positions, the
    smaller source comes first, null last."""
    order = [F.col("position").asc(), F.col("source").asc_nulls_last(), F.col("at").asc()]
    return sums_before(copies.withColumn("_one", F.lit(1).cast("long")), [], order, {"sequence": "_one"}).drop("_one")
