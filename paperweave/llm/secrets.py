"""Secret scans with multipart credential linking. DataFrame functions only.

Certain patterns are reported as they are. Weak candidates (long random-looking
strings, account identifiers, endpoints) are reported only when an interval
join finds the complementary part of a credential near them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.llm.common import stored

# The base patterns, and the least length that counts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12

# Weak candidates. Starts are bounded to the left, so each is found in linear time.
BLOB = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}"
IDENT = (r"""(?i)\b(?:client_?id|account_?id|access_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?"""
         r"[A-Za-z0-9@+/_.-]{4,}")
ENDPOINT = r"""(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]{4,}"""

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "blob", "ident", "endpoint")
BASE = KINDS[:3]
ROLE = {"assign": "secret", "hex": "secret", "blob": "secret", "access": "ident", "ident": "ident",
        "endpoint": "endpoint"}
SCOPE = 400                  # code points between two parts of one credential, at most
CHUNK = 256                  # matches whose places are added up at once
SPAN = "struct<start: int, kind: int, end: int>"
NONE = f"cast(array() AS array<{SPAN}>)"


def found_spans(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost non-overlapping matches as spans in code points: the lengths
    of the pieces between the matches and of the matches, added up. Only texts
    that match are split. Sums run in chunks, so that the arrays they append to
    stay short however many matches a text has."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
                         F.transform(hits, F.length).alias("len"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK)),
                         lambda i: F.slice(pairs, (i * CHUNK + 1).cast("int"), F.lit(CHUNK)))

    def add(acc, p):
        start = acc["at"] + p["gap"]
        return F.when(p["len"].isNull(), acc).otherwise(F.struct(
            (start + p["len"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
                                                  (start + p["len"]).alias("end")))).alias("out")))

    def join(acc, c):
        moved = F.transform(c["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["kind"].alias("kind"),
                                                         (s["end"] + acc["at"]).alias("end")))
        return F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    one = F.struct(F.lit(0).alias("at"), F.expr(NONE).alias("out"))
    all_chunks = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() AS array<array<{SPAN}>>)").alias("out"))
    summed = F.transform(chunks, lambda c: F.aggregate(c, one, add))
    return F.when(text.rlike(pattern), F.flatten(F.aggregate(summed, all_chunks, join, lambda acc: acc["out"]))
                  ).otherwise(F.expr(NONE))


def assign_spans(text: Column) -> Column:
    """As ``found_spans`` for assignments; matches with a short value are
    dropped after the search, so what they cover is not searched again."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    spans = found_spans(text, ASSIGN, "assign")
    return F.when(text.rlike(ASSIGN), F.transform(
        F.filter(F.arrays_zip(spans.alias("s"), F.transform(values, F.length).alias("n")),
                 lambda p: p["n"] >= ASSIGN_LEAST), lambda p: p["s"])).otherwise(F.expr(NONE))


def _apart(weak: Column, strong: Column) -> Column:
    """Weak spans that overlap no strong one."""
    return F.filter(weak, lambda w: ~F.exists(strong, lambda s: (w["start"] < s["end"]) & (s["start"] < w["end"])))


def linked_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The parts ``(text_key, start, kind, end)`` that belong to a pair of a
    secret and an identifier or endpoint at most ``scope`` apart.

    Interval join: the part that starts first is dealt to every cell of
    ``scope`` code points that it or the scope behind it touches, the other to
    the cell of its start. A cell holds at most ``scope`` starts, so neither a
    long text nor many copies make a large group.
    """
    role = F.element_at(F.array(*[F.lit(ROLE[k]) for k in KINDS]), F.col("kind") + 1)
    first = parts.select("text_key", F.struct("start", "kind", "end").alias("a"), role.alias("a_role"),
                         F.explode(F.expr(f"sequence(start div {scope}, (end + {scope}) div {scope})")).alias("cell"))
    second = parts.select("text_key", F.struct("start", "kind", "end").alias("b"), role.alias("b_role"),
                          F.expr(f"start div {scope}").alias("cell"))
    complementary = (F.col("a_role") != F.col("b_role")) & (
        (F.col("a_role") == "secret") | (F.col("b_role") == "secret"))
    pairs = first.join(second, ["text_key", "cell"]).where(
        complementary & (F.col("b.start") >= F.col("a.start")) & (F.col("b.start") <= F.col("a.end") + scope))
    return (pairs.select("text_key", F.explode(F.array("a", "b")).alias("p"))
            .select("text_key", "p.*").distinct())


def _found(docs: DataFrame, text_col: str) -> DataFrame:
    """All columns of ``docs`` with ``_base`` and ``_weak`` spans, and the
    SHA-256 ``_text_key`` of texts with weak ones."""
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    none = F.expr(NONE)
    found = docs.withColumns({"_t": t}).withColumns({
        "_assign": assign_spans(F.col("_t")), "_access": found_spans(F.col("_t"), ACCESS, "access"),
        "_hex": found_spans(F.col("_t"), HEX, "hex"), "_blob": found_spans(F.col("_t"), BLOB, "blob")})
    secret = F.size("_assign") + F.size("_hex") + F.size("_blob") > 0
    found = found.withColumns({
        "_base": F.array_sort(F.concat("_assign", "_access", "_hex")),
        "_ident": F.when(secret, found_spans(F.col("_t"), IDENT, "ident")).otherwise(none),
        "_endpoint": F.when(secret, found_spans(F.col("_t"), ENDPOINT, "endpoint")).otherwise(none)})
    found = found.withColumn("_weak", _apart(F.concat("_blob", "_ident", "_endpoint"), F.col("_base")))
    found = found.withColumn("_text_key", F.when(F.size("_weak") > 0, F.sha2("_t", 256)))
    return found.drop("_t", "_assign", "_access", "_hex", "_blob", "_ident", "_endpoint")


def _with_links(found: DataFrame, scope: int) -> DataFrame:
    """``_base`` and ``_spans`` beside the other columns of a stored ``_found``.
    Only rows with weak candidates are joined with the links of their text."""
    parts = (found.where(F.col("_text_key").isNotNull())
             .select(F.col("_text_key").alias("text_key"), F.explode(F.concat("_base", "_weak")).alias("p"))
             .select("text_key", "p.*").distinct())
    extra = (linked_parts(parts, scope).where(F.col("kind") >= len(BASE))
             .groupBy("text_key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("_extra")))
    weak = (found.where(F.col("_text_key").isNotNull()).join(extra, F.col("_text_key") == F.col("text_key"), "left")
            .withColumn("_spans", F.array_sort(F.concat("_base", F.coalesce(F.col("_extra"), F.expr(NONE)))))
            .drop("text_key", "_extra"))
    return found.where(F.col("_text_key").isNull()).withColumn("_spans", F.col("_base")).unionByName(weak).drop(
        "_weak", "_text_key")


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 scope: int = SCOPE) -> DataFrame:
    """One row per document (repeated rows included): ``id_col``, ``base`` (the
    certain spans) and ``spans`` (these and the linked weak candidates), arrays
    of (start, kind, end) by start, then kind; ``kind`` indexes ``KINDS``;
    offsets in code points, end exclusive.

    Weak candidates that overlap a certain span are dropped. The rest joins its
    complementary parts once per distinct text, keyed by the text's SHA-256,
    so a text that a third of all rows repeat is linked once. Spans are found
    in one scan and stored; only those of texts with weak candidates are shuffled.

    Null or empty text: no spans. A null id stays null. Other columns are not
    read; an empty table gives no rows.
    """
    narrow = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    found = stored(_found(narrow, "_text").drop("_text"), "secrets")
    return _with_links(found, scope).select(F.col("_id").alias(id_col), F.col("_base").alias("base"),
                                            F.col("_spans").alias("spans"))


def masked(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every run of overlapping spans replaced by the mask."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    between = lambda a, b: F.substring(text, a + 1, b - a)
    add = lambda acc, s: F.when(s["end"] <= acc["at"], acc).when(s["start"] < acc["at"], F.struct(
        s["end"].alias("at"), acc["out"].alias("out"))).otherwise(F.struct(
            s["end"].alias("at"), F.concat(acc["out"], between(acc["at"], s["start"]), F.lit(mask)).alias("out")))
    end = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, add, end)).otherwise(text)


def mask_secrets(docs: DataFrame, *, text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """All rows and columns of ``docs``; in ``text_col`` all reported secrets and
    identifiers are masked (endpoints stay). A null text stays null. Cases as
    in ``secret_spans``; rows are stored once, only those with weak candidates
    are shuffled."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    wide = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    rows = _with_links(stored(_found(wide, text), "secrets"), scope)
    hidden = F.filter("_spans", lambda s: s["kind"] != KINDS.index("endpoint"))
    return rows.withColumn(text, masked(F.col(text), hidden)).select(
        *[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
