"""Connected components of a table of links by alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.llm.common import gathered, packed, stored


def local_components(n: int, u: np.ndarray, v: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """For nodes 0 to n - 1 the smallest node of each one's component; ``label``
    holds what earlier links gave."""
    label = np.arange(n) if label is None else label
    while True:
        a, b = label[u], label[v]
        if np.array_equal(a, b):
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up


def _star(links: DataFrame, name: str, most: int) -> DataFrame:
    """Link the neighbours of each node ``u`` to the smallest of these and ``u``; there are ``most`` links at most."""
    links = gathered(links, most)
    least = stored(packed(links.groupBy("u").agg(F.min("v").alias("m")).select(
        "u", F.least("u", "m").alias("m")), most), name)
    return links.join(gathered(least, most), "u")


def components(links: DataFrame, max_rounds: int = 50, most: int | None = None) -> DataFrame:
    """``links(u, v)`` of comparable node ids, ``most`` of them if that is known, to ``(node, root)``: the smallest
    node of the component for every linked node but the root itself.

    Each round links every node's larger neighbours, then its smaller ones, to
    the least of them, until all components are stars: a few rounds even for
    long chains. Both inputs of a round's join are stored tables, so AQE can
    split a hub. Links to itself and repeated ones don't matter; nulls are dropped.
    """
    links = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = stored(links if most is None else packed(links, most), "links")
    state = _state(links)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        most = 2 * state[0]     # nodes; the round's tables have about as many rows, twice that at most
        large = stored(packed(_star(both, "large", most).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                              .distinct(), most), "large")
        small = _star(large, "small", most)
        links = stored(packed(small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                                             F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                              .select("e.*").where("u != v").distinct(), most), "links")
        before, state = state, _state(links)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(links: DataFrame) -> tuple:
    """Number and checksum of the links: equal when a round changes nothing."""
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s
