"""Approximate cosine top-k by random projections (V3, approximate).

The sign of a vector's product with a random direction is a bit; the bits of a
table are a code, and vectors at a small angle tend to share it. A seed is
compared, exactly, with the vectors that share one of its codes in one of the tables (or a code with one of its least
certain bits flipped). ``similar`` is the exact form and stays the default.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweave.operators.similarity import (
    _OUT_SCHEMA,
    _SCALE,
    CHUNK_SCORES,
    SIMILAR_LIMIT,
    _best,
    _block_top_k,
    _matrix,
    _rows,
    _unit_rows,
    in_blocks,
)
from paperweave.operators.topn import top_n
from paperweave.session import cut_lineage

TABLES = 12
BUCKET_ROWS = 64             # vectors of a code on average, from which the number of bits follows
GROUP_ROWS = 4096            # vectors, or seeds, of a code that one task compares at once
MAX_BITS = 30
MARGIN = 1e-5                # more than a product of unit vectors in single precision can be off
_NULL = "\0\1"                # stands for a null id, before all others
CODED_ROWS = 512             # vectors that a task gives their codes at once: it holds a copy of each per table and probe


def directions(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    """Orthogonal in groups of ``dim``, which cuts the angles more evenly than independent ones."""
    rnd, out = np.random.default_rng([seed, dim]), []
    while sum(len(o) for o in out) < tables * bits:
        out.append(np.linalg.qr(rnd.normal(size=(dim, dim)))[0].T if dim > 1 else np.ones((1, 1)))
    return np.concatenate(out)[:tables * bits]


def _coded(m: np.ndarray, tables: int, bits: int, probes: int, seed: int) -> np.ndarray:
    """(vector, table, probe): the codes, the vector's own first."""
    weight = 1 << np.arange(bits, dtype=np.int64)
    x = (m @ directions(m.shape[1], tables, bits, seed).T).reshape(len(m), tables, bits)
    code = (x > 0) @ weight
    alone = [code]
    order = np.argsort(np.abs(x), axis=2)                            # the least certain bits first
    for p in range(min(probes, bits)):
        alone.append(code ^ weight[order[:, :, p]])
    return np.stack(alone, axis=2)


def _codes(tables: int, bits: int, probes: int, seed: int):
    """Task function: a row per table, and per probe, with the code."""
    def run(frames):
        for f in (frame[lo:lo + CODED_ROWS] for frame in frames for lo in range(0, len(frame), CODED_ROWS)):
            f = f[[v is not None and len(v) > 0 for v in f["vec"]]]
            if f.empty:
                continue
            m = _matrix(f["vec"], "vectors")
            coded = _coded(m, tables, bits, probes, seed)
            flat = coded.reshape(len(f), -1)                         # by table, then probe
            each = flat.shape[1]
            yield pd.DataFrame({"id": np.repeat(f["id"].to_numpy(), each), "vec": np.repeat(f["vec"].to_numpy(), each),
                                "tab": np.tile(np.repeat(np.arange(tables), coded.shape[2]), len(f)), "code": flat.ravel()})

    return run


def _dealt(coded: DataFrame, sizes: DataFrame, name: str, other: str) -> DataFrame:
    """Each code's rows in parts of about GROUP_ROWS, and a copy for each part of the other side."""
    parts = F.ceil(F.col(f"{name}_n") / GROUP_ROWS).cast("int")
    others = F.ceil(F.col(f"{other}_n") / GROUP_ROWS).cast("int")
    return (coded.join(sizes, ["tab", "code"]).withColumn(f"{name}_part", F.pmod(F.xxhash64("id", "vec"), parts).cast("int"))
            .withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0), others - 1))).drop("s_n", "c_n"))


def _shared(q: np.ndarray, c: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Whether a seed and a vector have a code of one table in common, pair by pair."""
    out = np.zeros(np.broadcast_shapes(rows.shape, cols.shape), bool)
    for t in range(c.shape[1]):
        for p in range(q.shape[2]):
            out |= q[rows, t, p] == c[cols, t, 0]
    return out


def _dense(tables: int, bits: int, probes: int) -> bool:
    """By their codes, each seed would meet as many vectors as there are, or more."""
    return tables * (1 + min(probes, bits)) >= 1 << bits


def _block_shared_top_k(limit: int, tables: int, bits: int, probes: int, seed: int):
    """As ``_block_top_k``, of the pairs that share a code. All products are made once, in single precision; the
    ``limit``-th of some vectors bounds that of all, and only pairs that reach it are looked at and scored exactly."""
    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return _rows([])
        q_all, c_all = _matrix(q["q_vec"], "seed vectors"), _matrix(c["c_vec"], "cached vectors")
        if q_all.shape[1] != c_all.shape[1]:
            raise ValueError(f"seed dimension {q_all.shape[1]} != cache dimension {c_all.shape[1]}")
        (qm, q_ok), (cm, c_ok) = _unit_rows(q_all), _unit_rows(c_all)
        q_ids, c_ids = q["seed_id"].to_numpy()[q_ok], c["c_id"].to_numpy()[c_ok]
        if not len(q_ids) or not len(c_ids):
            return _rows([])
        q_code, c_code = _coded(q_all[q_ok], tables, bits, probes, seed), _coded(c_all[c_ok], tables, bits, 0, seed)
        known = np.array([_NULL if x is None else x for x in c_ids], dtype=str)
        names, once, name = np.unique(known, return_index=True, return_inverse=True)
        at = {x: k for k, x in enumerate(names)}
        own = np.array([at.get(x, -1) for x in q_ids])               # X9: a seed is not its own neighbour
        some = once[:max(limit, len(names) // 16)]
        q32, c32 = qm.astype(np.float32), cm.astype(np.float32).T
        step = max(1, CHUNK_SCORES // len(c_ids))
        parts = []
        for lo in range(0, len(q_ids), step):
            near = q32[lo:lo + step] @ c32
            n = len(near)
            least = np.full(n, -np.inf)
            if len(some) >= limit:
                seen = near[:, some].astype(float)
                seen[~_shared(q_code, c_code, np.arange(lo, lo + n)[:, None], some[None, :]) | (name[some][None, :] == own[lo:lo + n, None])] = -np.inf
                least = np.partition(seen, len(some) - limit, axis=1)[:, len(some) - limit]
            row, col = np.nonzero(near >= (least - MARGIN)[:, None])
            row += lo
            keep = _shared(q_code, c_code, row, col) & (name[col] != own[row])
            row, col = row[keep], col[keep]
            score = np.rint(np.einsum("ij,ij->i", qm[row], cm[col]) * _SCALE) / _SCALE
            order = np.lexsort((name[col], -score, row))
            row, col, score = row[order], col[order], score[order]
            if len(names) < len(c_ids):                              # copies of an id count once, by their best score
                best = np.sort(np.unique(row * len(names) + name[col], return_index=True)[1])
                row, col, score = row[best], col[best], score[best]
            nth = np.arange(len(row)) - np.searchsorted(row, row, "left")
            parts.append((q_ids[row[nth < limit]], c_ids[col[nth < limit]], score[nth < limit]))
        return _rows(parts)

    return run


def similar_approximate(vectors: DataFrame, seeds: DataFrame, limit: int = SIMILAR_LIMIT, tables: int = TABLES,
                        bits: int | None = None, probes: int = 0, seed: int = 1) -> DataFrame:
    """As ``similar``, (seed_id, id, score, rank), but some of the best may be missing; scores are exact.

    Fewer ``bits``, more ``tables`` or ``probes`` find more and compare more. By default the bits follow the number of vectors, so a code has about
    BUCKET_ROWS of them and the work of a seed grows slowly; how many of the true neighbours are found depends on how near they are
    (with all of them at wide angles, as among random vectors, nearly all pairs must be compared to find most). Copies of one vector are
    compared once: of their ids, the ``limit`` + 1 smallest can matter. Codes with many vectors or
    seeds are dealt out in parts, so no group grows with the data; with so few codes that nearly all pairs share one, vectors travel in blocks as in ``similar``. Vectors have one dimension."""
    cache = vectors.select(F.col("paper_id").alias("id"), F.col("embedding").alias("vec")).where("vec is not null")
    n = cache.count()
    if bits is None:
        bits = max(1, min(MAX_BITS, round(math.log2(max(2, n) / BUCKET_ROWS))))
    # of equal vectors, the smallest ids; of rows of one id, its vectors
    distinct = top_n(cache.distinct(), ["vec"], [F.col("id").asc()], limit + 1)
    asked = cache.join(seeds.select(F.col("seed_id").alias("id")).distinct(), "id", "left_semi")
    if _dense(tables, bits, probes):
        # every pair is met once, in blocks
        q, c = asked.withColumnsRenamed({"id": "seed_id", "vec": "q_vec"}), distinct.withColumnsRenamed({"id": "c_id", "vec": "c_vec"})
        full = lambda df, vec: df.where(F.size(vec) > 0)
        return _best(in_blocks(full(q, "q_vec"), full(c, "c_vec"), _block_shared_top_k(limit, tables, bits, probes, seed), n), limit)
    schema = T.StructType([*cache.schema.fields, T.StructField("tab", T.LongType()), T.StructField("code", T.LongType())])
    c = distinct.mapInPandas(_codes(tables, bits, 0, seed), schema)
    s = asked.mapInPandas(_codes(tables, bits, probes, seed), schema)
    count = lambda df, name: df.groupBy("tab", "code").agg(F.count(F.lit(1)).alias(name))
    sizes = count(c, "c_n").join(count(s, "s_n"), ["tab", "code"])
    sizes = cut_lineage(sizes)               # narrow; a row per code in use
    left = _dealt(s, sizes, "s", "c").withColumnsRenamed({"id": "seed_id", "vec": "q_vec"})
    right = _dealt(c, sizes, "c", "s").withColumnsRenamed({"id": "c_id", "vec": "c_vec"})
    group = ["tab", "code", "s_part", "c_part"]
    local = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(_block_top_k(limit), _OUT_SCHEMA)
    return _best(local, limit)
