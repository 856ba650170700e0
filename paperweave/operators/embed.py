"""Document embeddings (V1, V2).

The encoder is pluggable: ``make_encoder`` is a zero-argument factory that
returns ``predict(texts: np.ndarray) -> np.ndarray`` (one float row per
text). The factory is called once per Python worker (the model is loaded
once, not per task or row) and gets ``batch_size`` texts at a time. Any model (a transformer's first-token vector, as the
reference uses) fits behind the same factory; the built-in
``hashing_encoder`` is a deterministic stand-in with no model files.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweave.operators.joins import missing_vectors
from paperweave.operators.project import embedding_text
from paperweave.operators.tables import DuplicateKeyError
from paperweave.worker import new_key, shared

EncoderFactory = Callable[[], Callable[[np.ndarray], np.ndarray]]

_WORD = re.compile(r"\w+", re.UNICODE)


def hashing_encoder(dim: int = 64, max_tokens: int | None = None) -> EncoderFactory:
    """Signed feature hashing of lower-cased words over the whole text (or its
    first ``max_tokens`` words, as a transformer would cut it), L2-normalised; an
    all-zero vector for a text without words."""
    def make():
        def predict(texts: np.ndarray) -> np.ndarray:
            words = [_WORD.findall(str(t).lower())[:max_tokens] for t in texts]
            # every distinct word is hashed once; a batch is then one weighted count
            ids = {w: i for i, w in enumerate({w for ws in words for w in ws})}
            h = np.fromiter((zlib.crc32(w.encode("utf-8")) for w in ids), np.int64, len(ids))
            at = np.fromiter((ids[w] for ws in words for w in ws), np.int64, sum(map(len, words)))
            row = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
            out = np.bincount(row * dim + h[at] % dim, weights=np.where(h[at] >> 31 & 1, 1.0, -1.0),
                              minlength=len(texts) * dim).reshape(len(texts), dim).astype(np.float32)
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            np.divide(out, norms, out=out, where=norms > 0)
            return out
        return predict
    return make


def embed(texts: DataFrame, make_encoder: EncoderFactory, batch_size: int = 64,
          text_col: str = "text", id_col: str = "paper_id") -> DataFrame:
    """V1: (paper_id, embedding) for every row of ``texts``."""
    sent = texts.sparkSession.sparkContext.broadcast(cloudpickle.dumps(make_encoder))
    key = new_key()

    def run(frames):
        predict = shared(key, lambda: cloudpickle.loads(sent.value)())
        for f in frames:
            for lo in range(0, len(f), batch_size):
                part = f.iloc[lo:lo + batch_size]
                yield pd.DataFrame({"paper_id": part["paper_id"], "embedding": list(np.asarray(predict(part["text"].to_numpy())))})

    rows = texts.select(F.col(id_col).alias("paper_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, T.StructType([rows.schema["paper_id"], T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def refresh_vectors(works: DataFrame, cache: DataFrame, make_encoder: EncoderFactory,
                    abstract: str = "raw", batch_size: int = 64) -> DataFrame:
    """V2: the whole cache after embedding every work that has no vector
    yet (J4 anti join, V1). Stored vectors are never recomputed, and the lazy
    embedding is used once: the new ids are not in the cache, so the upsert (K4) is
    a union, and their uniqueness is checked on the ids alone. A work id that occurs twice raises ``DuplicateKeyError``.
    Write the result with ``tables.overwrite`` (it reads the cache)."""
    missing = missing_vectors(works, cache)
    if missing.groupBy("id").count().where(F.col("count") > 1).limit(1).count():
        raise DuplicateKeyError("a work without a vector occurs twice")
    fresh = embed(embedding_text(missing, abstract), make_encoder, batch_size)
    stored = cache.select("paper_id", "embedding")
    return stored.unionByName(fresh.select(*stored.columns))
