"""Small document tables with all awkward cases."""

import random
from contextlib import contextmanager

from pyspark.sql import types as T

# Names that the operators could use inside; they must not matter.
CLASHES = ("id", "fp", "_t", "text_key", "shard", "slot", "arc", "lo", "base", "cell", "home", "gram", "kept", "ids",
           "n_words", "distance", "spans", "host", "rule", "row", "token", "c0", "_c0", "_carry0", "_n_words", "_text", "item")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASHES]])
SYLLABLES = "en the on er in ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi".split()


def prose(rnd, n):
    return " ".join("".join(rnd.choices(SYLLABLES, k=rnd.randint(1, 4))) + rnd.choice(["", "", "", ",", "."])
                    + ("\n" if rnd.random() < 0.05 else "") for _ in range(n))


def awkward_rows(seed=3):
    rnd = random.Random(seed)
    shared = prose(rnd, 60)
    rows = [(i, prose(rnd, rnd.randint(1, 400)), rnd.choice(["en", "de", None]), rnd.choice(["a", "b", None])) for i in range(70)]
    one = rows[0]
    rows += [(100 + i, one[1], "en", "a") for i in range(15)]                                   # exact copies
    rows += [(200 + i, rows[5 + i][1] + " " + shared, "en", "a") for i in range(12)]            # a shared passage
    rows += [(300, None, None, None), (301, "", "en", "a"), (302, " \n\t ", "en", "a"), (None, one[1], "en", "a"),
             (None, None, None, None), (303, "x" * 30_000, "en", "a"), (304, "a b " * 4000, "en", "a"),
             (305, prose(rnd, 4000), "en", "b"), (306, "Ünïcödé 中文 😀 ▁ " * 30, "fr", "b"), (307, "one", "en", "a"),
             (308, "two words", "en", "a")]
    rows += [(400, shared, "en", "a")] * 3                                                      # repeated rows
    rows += [(400, "another text under the same id " * 12, "en", "a")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, s, None if t is None else len(t), *["clash"] * len(CLASHES))
                                  for d, t, lang, s in rows], SCHEMA)


@contextmanager
def dealt_out(spark, parts=13):
    """Shuffles have so many parts, which adaptive execution leaves alone."""
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": str(parts)}
    was = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
