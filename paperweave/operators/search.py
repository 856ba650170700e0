"""Title search: index build (A1), BM25 (J6, A2, L1), DOI match (X6, L5) and
substring match (X7, L4).

BM25 (the text-index defaults): k1 = 1.2, b = 0.75, any-term matching, query
terms deduplicated, tokens from F2, no stemming and no stop words, N and the
mean length over works with a title:

    score = sum over shared terms of
            log10((N - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1)
            / (tf + k1 * (1 - b + b * len / avgdl))
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperweave.functions.stem import stems
from paperweave.functions.text import is_doi_like, like_pattern, py_strip, tokens
from paperweave.functions.vectors import SCORE_DIGITS, rounded
from paperweave.operators.topn import (
    BROADCAST_BYTES,
    BROADCAST_ROWS,
    checked_broadcast,
    fits_broadcast,
    top_n,
)
from paperweave.session import staged

K1 = 1.2
B = 0.75
SEARCH_LIMIT = 20
# Query terms that are pushed into the postings scan as a list.
PUSHED_TERMS = 200
# Patterns without a literal character that are broadcast at once.
BLOCK_PATTERNS = 10_000
GRAM_SIZES = (3, 2, 1)
# Largest literal query table matched by a nested loop in substring search:
# a handful of queries is one pass over the titles with a few ``contains``
# tests per title. Larger tables take the trigram equi-join, whose work
# grows with the matches, not with queries x titles.
NESTED_LOOP_QUERY_ROWS = 16


@dataclass
class TitleIndex:
    postings: DataFrame   # term, id, tf, doc_len (clustered by work id)
    terms: DataFrame      # term, df (the term dictionary)
    stats: DataFrame      # one row: n_docs, avgdl
    stopwords: tuple = ()  # removed from titles and, by the query side, from queries
    stem: bool = False     # terms are stems, of titles and queries
    bounds: DataFrame | None = None  # term, len_class, df, max_tf, min_len (of a saved index)
    parts: int = 1         # segments that the index consists of

    def n_docs(self) -> Column:
        return self.stats.select("n_docs").scalar()

    def avgdl(self) -> Column:
        return self.stats.select("avgdl").scalar()

    def postings_with_df(self) -> DataFrame:
        """Every posting with its term's document frequency. Search never
        needs this join: it looks up df for the query terms only."""
        return self.postings.join(self.df_of(), "term").select("term", "id", "tf", "doc_len", "df")

    def df_of(self, some: DataFrame | None = None) -> DataFrame:
        """(term, df), of all terms or of those in ``some`` (distinct; its broadcast already decided)."""
        base = self.terms if self.parts == 1 else self.bounds.select("term", "df")
        terms = base if some is None else base.join(some, "term", "left_semi")
        return terms if self.parts == 1 else terms.groupBy("term").agg(F.sum("df").alias("df"))


def _drop_stopwords(toks: Column, stopwords) -> Column:
    if not stopwords:
        return toks
    return F.filter(toks, lambda t: ~t.isin(list(stopwords)))


def _stems_if(stem: bool, toks: Column) -> Column:
    """The tokens, or their stems: each batch stems its distinct words where it is, so no
    token is shuffled however many different words there are."""
    return stems(toks) if stem else toks


def build_title_index(works: DataFrame, stopwords=(), partitions: int | None = None, stem: bool = False) -> TitleIndex:
    """A1: postings (term frequency and document length per work and term),
    the term dictionary (document frequency per term) and the collection
    statistics. ``stopwords`` (optional, none by default) are removed from
    titles before counting, and from queries searched against this index.
    ``stem`` counts Porter stems instead of words ("network" finds
    "networks"), of queries as well; document lengths stay the same.

    Titles (one row each) are hash-partitioned by work id once, into
    ``partitions`` parts (default: the shuffle partition count); tokens are
    exploded and counted inside those partitions, so postings come out
    clustered by id with no further shuffle, and a title's postings are
    bounded by its length (no hot key). df counts each title's distinct
    tokens per term straight from the scan (a partial count: only
    (term, partial count) pairs move, however common a term is, and titles
    are not shuffled for it). Postings are never joined with df here;
    search looks df up for its query terms.
    """
    docs = works.where(F.col("title").isNotNull()).select(
        "id", _drop_stopwords(tokens(F.col("title")), stopwords).alias("toks"))
    stats = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("toks")).alias("avgdl"),
                     F.coalesce(F.sum(F.size("toks")), F.lit(0)).alias("n_tokens"))
    # the titles travel as they are, or as one text of their stems: a fraction of their tokens' size. Stems are made before
    # that, since what leaves a Python function isn't known to be clustered any more
    text = F.array_join(stems(_drop_stopwords(tokens(F.col("title")), stopwords)), " ") if stem else F.col("title")
    whole = works.where(F.col("title").isNotNull()).select("id", text.alias("title"))
    by_id = whole.repartition(partitions, "id") if partitions else whole.repartition("id")
    toks = F.split("title", " ") if stem else _drop_stopwords(tokens(F.col("title")), stopwords)
    by_id = (by_id.where(F.col("title") != "") if stem else by_id).select("id", toks.alias("toks"))
    tokens_of = by_id.select("id", F.size("toks").alias("doc_len"), F.explode("toks").alias("term"))
    postings = (tokens_of.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("doc_len").alias("doc_len"))
                .select("term", "id", "tf", "doc_len"))
    # each title's distinct tokens, counted per term straight from the scan:
    # the dictionary needs no shuffle by id
    if stem:                     # two words of a title can have one stem
        terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    else:
        terms = (docs.select(F.explode(F.array_distinct("toks")).alias("term"))
                 .groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    return TitleIndex(postings=postings, terms=terms, stats=stats, stopwords=tuple(stopwords), stem=stem)


def _len_class(doc_len: Column) -> Column:
    """Lengths from one power of two to the next are a class."""
    return F.length(F.bin(doc_len)).cast("int")


def save_title_index(index: TitleIndex, path: str, mode: str = "overwrite",
                     table: str | None = None, buckets: int | None = None, clustered: bool = True) -> None:
    """Persist the index as Parquet under ``path``.

    Postings keep their clustering by work id (``build_title_index``) and are
    sorted by term inside each file: all postings of one title sit in one
    task, so the per-(query, work) BM25 sum of a query batch completes in
    the map-side partial aggregate and only finished sums are shuffled.
    ``buckets`` re-clusters them into that many files; so does ``clustered=False``,
    for postings that aren't clustered by id.

    With ``table`` (a catalog name) and ``buckets``, postings are saved as a
    table bucketed by id instead: the plan then knows the clustering, the
    sum needs no shuffle at all, and only each query's partial top-k moves.
    Build with ``partitions=buckets`` so each task writes one bucket file.
    The term dictionary is counted from the written postings and saved
    sorted by term, and so is what bounds a term's scores: for each class of title lengths its
    highest frequency and least length.
    """
    post = index.postings
    if table:
        (post.write.mode(mode).bucketBy(buckets or 200, "id").sortBy("term")
         .option("path", f"{path}/postings").saveAsTable(table))
        saved = post.sparkSession.table(table)
    else:
        post = post.repartition(buckets, "id") if buckets else post if clustered else post.repartition("id")
        post.sortWithinPartitions("term", "id").write.mode(mode).parquet(f"{path}/postings")
        saved = post.sparkSession.read.parquet(f"{path}/postings")
    # counted from the written postings (narrow columns), so the titles are
    # tokenized and shuffled once
    bounds = saved.groupBy("term", _len_class(F.col("doc_len")).alias("len_class")).agg(
        F.count(F.lit(1)).alias("df"), F.max("tf").alias("max_tf"), F.min("doc_len").alias("min_len"))
    bounds.sortWithinPartitions("term").write.mode(mode).parquet(f"{path}/bounds")
    terms = post.sparkSession.read.parquet(f"{path}/bounds").groupBy("term").agg(F.sum("df").alias("df"))
    terms.sortWithinPartitions("term").write.mode(mode).parquet(f"{path}/terms")
    stop = F.array(*[F.lit(w) for w in index.stopwords]).cast("array<string>")
    index.stats.withColumn("stopwords", stop).withColumn("stem", F.lit(index.stem)).coalesce(1).write.mode(mode).parquet(f"{path}/stats")


def merged_stats(stats: DataFrame) -> DataFrame:
    """The statistics of several parts together: one row."""
    n, tokens_ = F.sum("n_docs"), F.sum("n_tokens")
    return stats.agg(n.alias("n_docs"), F.when(n > 0, tokens_ / n).alias("avgdl"), tokens_.alias("n_tokens"))


def index_of(postings: DataFrame, bounds: DataFrame, stats: DataFrame, stopwords=(), stem: bool = False, parts: int = 1,
             terms: DataFrame | None = None) -> TitleIndex:
    """The index whose saved parts these are."""
    if terms is None:
        terms = bounds.groupBy("term").agg(F.sum("df").alias("df"))
    return TitleIndex(postings=postings, terms=terms, stats=stats, stopwords=tuple(stopwords or ()), stem=stem, bounds=bounds, parts=parts)


def load_title_index(spark, path: str, table: str | None = None) -> TitleIndex:
    """Read an index written by ``save_title_index`` (``table``: the catalog
    name it was saved under, for the bucketed form)."""
    stats = spark.read.parquet(f"{path}/stats")
    kept = stats.select("stopwords", "stem").first()
    postings = spark.table(table) if table else spark.read.parquet(f"{path}/postings")
    return index_of(postings, spark.read.parquet(f"{path}/bounds"), stats.select("n_docs", "avgdl", "n_tokens"), kept["stopwords"], kept["stem"],
                    terms=spark.read.parquet(f"{path}/terms"))


def query_terms(queries: DataFrame, stopwords=(), stem: bool = False) -> DataFrame:
    """Distinct tokens (or stems) of each query (query_id, term)."""
    toks = _drop_stopwords(tokens(F.col("q")), stopwords)
    terms = queries.select("query_id", F.explode(F.array_distinct(_stems_if(stem, F.array_distinct(toks)))).alias("term"))
    return terms.distinct() if stem else terms


def term_matches(index: TitleIndex, queries: DataFrame, broadcast_terms: bool | None = None,
                 few_terms: bool = False) -> DataFrame:
    """Query terms, with their df from the term dictionary, joined to the
    postings on term. A query-term table of
    checked small size is broadcast, so the postings stream through the join
    without a shuffle; a larger one takes a shuffle join, where AQE splits the
    partitions of very common terms. ``broadcast_terms``: the caller already
    checked the size of these terms (or of a superset); ``None`` checks here.
    ``few_terms``: the caller has counted at most ``PUSHED_TERMS``; they become
    a filter of the postings scan, which skips row groups of other terms (saved
    files are sorted by term)."""
    terms = query_terms(queries, index.stopwords, index.stem)
    postings = index.postings
    if few_terms:
        wanted = [r.term for r in terms.select("term").distinct().collect()]
        postings = postings.where(F.col("term").isin(wanted))
    if broadcast_terms is None:
        broadcast_terms = fits_broadcast(terms)
    # df of the query terms only
    asked = F.broadcast(terms) if broadcast_terms else terms
    with_df = asked.join(index.df_of(asked.select("term")) if index.parts > 1 else index.terms, "term")
    return (F.broadcast(with_df) if broadcast_terms else with_df).join(postings, "term")


def _idf(n: Column, df: Column) -> Column:
    return F.log10((n - df + 0.5) / (df + 0.5) + 1)


def _tf_part(tf: Column, doc_len: Column, avgdl: Column, k1: float, b: float) -> Column:
    """Grows with tf, falls with doc_len."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * doc_len / avgdl))


def bm25_scores(index: TitleIndex, queries: DataFrame, k1: float = K1, b: float = B,
                broadcast_terms: bool | None = None, few_terms: bool = False) -> DataFrame:
    """A2: BM25 score of every (query, work) sharing at least one term."""
    n, avgdl = index.n_docs(), index.avgdl()
    df, tf, dl = F.col("df"), F.col("tf"), F.col("doc_len")
    part = _idf(n, df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
    return (term_matches(index, queries, broadcast_terms, few_terms)
            .groupBy("query_id", "id").agg(F.sum(part).alias("raw_score"))
            .select("query_id", "id", rounded(F.col("raw_score")).alias("score")))


def bm25_top(index: TitleIndex, queries: DataFrame, limit: int = SEARCH_LIMIT,
             broadcast_terms: bool | None = None, few_terms: bool = False) -> DataFrame:
    """L1: best ``limit`` works per query, score descending then id."""
    return _ranked(bm25_scores(index, queries, broadcast_terms=broadcast_terms, few_terms=few_terms), limit)


def _ranked(scores: DataFrame, limit: int) -> DataFrame:
    return top_n(scores, ["query_id"], [F.col("score").desc(), F.col("id").asc()], limit, rank_col="rank")


@dataclass
class PrunedSearch:
    top: DataFrame         # as bm25_top
    met: DataFrame         # query_id, id, partial: pairs that share a term which can decide
    scored: DataFrame      # query_id, id, score: pairs scored with all their terms


def bm25_pruned(index: TitleIndex, queries: DataFrame, limit: int = SEARCH_LIMIT, k1: float = K1, b: float = B) -> PrunedSearch:
    """L1 without scoring every pair that shares a term (max-score pruning); exact.

    A term's score in a class of title lengths is at most that of its highest frequency in the least length. (1) The rarer half
    of a query's terms finds ``limit`` works, whose whole scores give a score to beat. (2) In each class, the
    terms of the lowest bounds that together can't reach it are set aside: a work with no other term is never met, so
    the long postings of common terms are not joined. Works met stay if the terms set aside could still lift
    them over the score to beat. (3) Only these are scored with the terms set aside, by an equi-join on work and term.

    Needs a saved index (``save_title_index`` or segments). Small intermediate tables (query terms, scores to beat, pairs met) are stored in
    the scratch folder. Best for many works and queries with common terms; a small
    table of short titles is scored faster as a whole.
    """
    if index.bounds is None:
        raise ValueError("pruning needs a saved index")
    stats = index.stats.select("n_docs", "avgdl").first()
    n, avgdl = F.lit(stats["n_docs"] or 0), F.lit(float(stats["avgdl"] or 1.0))
    asked = query_terms(queries, index.stopwords, index.stem)
    own = index.bounds.join(checked_broadcast(asked.select("term").distinct()), "term", "left_semi").groupBy("term", "len_class").agg(
        F.sum("df").alias("class_df"), F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len"))
    idf = own.groupBy("term").agg(F.sum("class_df").alias("df")).select("term", _idf(n, F.col("df")).alias("idf"))
    most = F.col("idf") * _tf_part(F.col("max_tf"), F.col("min_len"), avgdl, k1, b)
    terms = _staged(asked.join(own, "term").join(idf, "term").select("query_id", "term", "idf", "len_class", most.alias("most")), "terms")
    postings = index.postings.withColumn("len_class", _len_class(F.col("doc_len")))
    part = F.col("idf") * _tf_part(F.col("tf"), F.col("doc_len"), avgdl, k1, b)

    def met(some: DataFrame, value: str) -> DataFrame:
        """What the classes of terms in ``some`` give to the works that hold them."""
        return (checked_broadcast(some.select("query_id", "term", "len_class", "idf")).join(postings, ["term", "len_class"])
                .groupBy("query_id", "id").agg(F.sum(part).alias(value), F.first("len_class").alias("len_class")))

    def given(pairs: DataFrame, some: DataFrame) -> DataFrame:
        """What the classes of terms in ``some`` give to these pairs (query_id, id, len_class)."""
        wanted = pairs.select("query_id", "id", "len_class").join(some.select("query_id", "term", "len_class", "idf"), ["query_id", "len_class"])
        return (checked_broadcast(wanted).join(postings.drop("len_class"), ["id", "term"])
                .groupBy("query_id", "id").agg(F.sum(part).alias("more")))

    # (1) a score that limit works reach
    by_term = terms.groupBy("query_id", "term").agg(F.max("most").alias("most"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("most").desc(), "term"))
    of = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    rarer = by_term.withColumns({"_nth": nth, "_of": of}).where(2 * F.col("_nth") <= F.col("_of") + 1).select("query_id", "term")
    rare_terms, other = terms.join(rarer, ["query_id", "term"], "left_semi"), terms.join(rarer, ["query_id", "term"], "left_anti")
    first = _staged(top_n(met(rare_terms, "partial"), ["query_id"], [F.col("partial").desc(), F.col("id")], limit), "first")
    whole = first.join(given(first, other), ["query_id", "id"], "left").withColumn("score", F.col("partial") + F.coalesce("more", F.lit(0.0)))
    # (2) the terms that decide, class by class; scores are compared as rounded ones are
    beat = F.coalesce("beat", F.lit(0.0)) - 10.0 ** (1 - SCORE_DIGITS)
    upto = F.sum("most").over(Window.partitionBy("query_id", "len_class").orderBy("most", "term"))
    flagged = _staged(terms.join(_beat_table(whole, limit), "query_id", "left").withColumn("beat", beat)
                      .withColumn("decides", upto >= F.col("beat")), "flags")
    rest = flagged.groupBy("query_id", "len_class").agg(
        F.max("beat").alias("beat"), F.coalesce(F.sum(F.when(~F.col("decides"), F.col("most"))), F.lit(0.0)).alias("rest"))
    pairs = _staged(met(flagged.where("decides"), "partial").join(rest, ["query_id", "len_class"])
                    .withColumn("stays", F.col("partial") + F.col("rest") >= F.col("beat")), "met")
    # (3) the rest of the scores of those that stay
    stay = pairs.where("stays")
    scored = stay.join(given(stay, flagged.where("not decides")), ["query_id", "id"], "left").select(
        "query_id", "id", rounded(F.col("partial") + F.coalesce("more", F.lit(0.0))).alias("score"))
    return PrunedSearch(top=_ranked(scored, limit), met=pairs.select("query_id", "id", "partial"), scored=scored)


def _beat_table(whole: DataFrame, limit: int) -> DataFrame:
    """(query_id, beat): the least of ``limit`` whole scores; queries with fewer have none."""
    return (whole.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("beat"))
            .where(F.col("_n") >= limit).select("query_id", "beat"))


def _staged(df: DataFrame, name: str) -> DataFrame:
    return staged(df, f"bm25-{name}")[0]


DOI_RESOLVER = r"^(?i)(https?://)?(dx\.)?doi\.org/"


def doi_key(col: Column, strip_prefix: bool = False) -> Column:
    """Lower-cased DOI; with ``strip_prefix`` a resolver URL prefix is removed
    so that a bare ``10.x/y`` and its URL form are equal."""
    key = F.lower(col)
    return F.regexp_replace(key, DOI_RESOLVER, "") if strip_prefix else key


def doi_matches(works: DataFrame, queries: DataFrame, wildcards: bool = False,
                strip_doi_prefix: bool = False) -> DataFrame:
    """(query_id, id) of works whose DOI equals the trimmed query,
    ignoring case. Only DOI-like queries (X5) are tried. Literal mode is an
    equi-join on the lower-cased DOI; ``wildcards`` gives ILIKE semantics:
    a pattern whose only wildcards are ``_`` by an equi-join on the masked text
    (``_same_length_hits``), one with ``%`` by the trigram equi-join of ``pattern_join``."""
    q = queries.where(is_doi_like(F.col("q"))).select("query_id", py_strip(F.col("q")).alias("q"))
    w = works.where(F.col("title").isNotNull()).select("id", "doi")
    if wildcards:
        # ILIKE = LIKE on lower-cased operands; whole-string match
        raw = q.select("query_id", F.lower("q").alias("raw"))
        texts = w.select("id", F.lower("doi").alias("lt")).where(F.col("lt").isNotNull())
        open_ended = F.col("raw").contains("%")
        return _same_length_hits(texts, raw.where(~open_ended)).unionByName(
            pattern_join(texts, _like_queries(raw.where(open_ended), contains=False), F.like(F.col("lt"), F.col("lq"))))
    hits = (q.select("query_id", doi_key(F.col("q"), strip_doi_prefix).alias("doi_key"))
            .join(w.select("id", doi_key(F.col("doi"), strip_doi_prefix).alias("doi_key")), "doi_key"))
    return hits.select("query_id", "id")


def doi_first(works: DataFrame, queries: DataFrame, wildcards: bool = False,
              strip_doi_prefix: bool = False, broadcast_queries: bool | None = None) -> DataFrame:
    """X6 + L5: the first DOI hit (by id) per query.

    Literal mode with a query table of checked size broadcasts the queries
    and streams the works through the join (no shuffle of works). A larger
    query table meets the works reduced to the smallest id per DOI (a
    partial aggregate, so a DOI shared by many works collapses map-side):
    every query then meets at most one work. ``broadcast_queries``: the
    caller already checked the size of ``queries``; ``None`` checks here."""
    if wildcards:
        return top_n(doi_matches(works, queries, True, strip_doi_prefix), ["query_id"],
                     [F.col("id").asc()], 1, rank_col="rank")
    q = queries.where(is_doi_like(F.col("q"))).select(
        "query_id", doi_key(py_strip(F.col("q")), strip_doi_prefix).alias("doi_key"))
    w = (works.where(F.col("title").isNotNull())
         .select("id", doi_key(F.col("doi"), strip_doi_prefix).alias("doi_key")))
    if broadcast_queries is None:
        broadcast_queries = fits_broadcast(q)
    if broadcast_queries:
        # works stream past the broadcast queries and are never shuffled; the
        # partial limit keeps one hit per query and map task, however many
        # works share a DOI
        return top_n(w.join(F.broadcast(q), "doi_key"), ["query_id"], [F.col("id").asc()], 1,
                     rank_col="rank").select("query_id", "id", "rank")
    first = w.groupBy("doi_key").agg(F.min("id").alias("id"))
    return q.join(first, "doi_key").select("query_id", "id", F.lit(1).alias("rank"))


def _grams(s: Column, n: int) -> Column:
    """Distinct n-character substrings; empty for shorter strings. A zero-width
    lookahead at each position captures the next n (one JVM call, no lambda)."""
    return F.array_distinct(F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{n}}}))"), 1))


def _longest_grams(runs: Column) -> Column:
    """The grams of 3, else of 2, else of 1 characters that the literal runs have."""
    def of(n: int):
        return F.array_distinct(F.flatten(F.transform(runs, lambda r: _grams(r, n))))

    by_size = [of(n) for n in GRAM_SIZES]
    return F.when(F.size(by_size[0]) > 0, by_size[0]).when(F.size(by_size[1]) > 0, by_size[1]).otherwise(by_size[2])


def substring_hits(works: DataFrame, queries: DataFrame, wildcards: bool = False,
                   broadcast_rows: int = NESTED_LOOP_QUERY_ROWS) -> DataFrame:
    """(query_id, id) for every work whose title contains the query,
    ignoring case (untrimmed query). With ``wildcards`` the query is an ILIKE
    pattern inside ``%...%`` (F8). Query tables of any size and queries of any
    length, see ``pattern_join``.
    """
    # both sides are lower-cased once, before the join (ILIKE is LIKE on
    # lower-cased operands), so the per-pair test is a plain contains / like
    lt = works.where(F.col("title").isNotNull()).select("id", F.lower("title").alias("lt"))
    lq = queries.select("query_id", F.lower("q").alias("lq"))
    if wildcards:
        pats = _like_queries(lq.withColumnRenamed("lq", "raw"), contains=True)
        return pattern_join(lt, pats, F.like(F.col("lt"), F.col("lq")), broadcast_rows)
    return pattern_join(lt, lq.withColumn("grams", _longest_grams(F.array("lq"))),
                        F.col("lt").contains(F.col("lq")), broadcast_rows)


def _like_queries(raw: DataFrame, contains: bool) -> DataFrame:
    """(query_id, raw) -> (query_id, lq, grams): ``lq`` is the LIKE pattern
    of the user text (inside ``%...%`` when ``contains``); ``grams`` are those
    of its literal runs between ``%`` and ``_``, taken from the raw text (the
    pattern doubles backslashes), each of which any match contains."""
    pat = like_pattern(F.col("raw"))
    if contains:
        pat = F.concat(F.lit("%"), pat, F.lit("%"))
    return raw.select("query_id", pat.alias("lq"), _longest_grams(F.split("raw", "[%_]")).alias("grams"))


def pattern_join(texts: DataFrame, queries: DataFrame, match: Column,
                 broadcast_rows: int = NESTED_LOOP_QUERY_ROWS) -> DataFrame:
    """(query_id, id) of every (query, text) pair for which ``match`` holds.

    ``texts``: (id, lt); ``queries``: (query_id, lq, grams), where ``grams``
    are substrings of one length (3, 2 or 1) that every matching ``lt``
    contains. At most ``broadcast_rows`` queries (counted) are tested in one
    scan of the texts. More go through exact gram equi-joins, one for each
    length: a query probes with its rarest gram and every candidate is
    verified. Queries without a literal character (only wildcards, or empty)
    are reduced to their distinct patterns, which are tested in broadcast
    blocks of bounded size.
    """
    # one bounded job sizes the query table and its kinds
    cap = max(broadcast_rows, BROADCAST_ROWS)
    queries = queries.where(F.col("lq").isNotNull())
    length = F.coalesce(F.length(F.get("grams", F.lit(0))), F.lit(0))
    sized = queries.limit(cap + 1).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("lq")), F.lit(0)).alias("bytes"),
        *[F.count(F.when(length == k, 1)).alias(f"n{k}") for k in (0, *GRAM_SIZES)]).first()
    small = sized["bytes"] <= BROADCAST_BYTES
    if sized["n"] <= broadcast_rows and small:
        return _nested(texts, queries, match)
    some = [k for k in (0, *GRAM_SIZES) if sized["n"] > cap or sized[f"n{k}"]]
    parts = [_gram_probe(texts, queries.where(length == k), match, k, probes_fit=sized["n"] <= BROADCAST_ROWS and small)
             for k in some if k]
    if 0 in some:
        parts.append(_wildcards_only(texts, queries.where(length == 0), match))
    out = parts[0] if parts else _nested(texts, queries, match)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _same_length_hits(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id) of every text equal to a pattern (query_id, raw) in which
    each ``_`` stands for any one character. The lengths of a pattern's literal runs
    are its shape; a text is masked once for each distinct shape of its
    length and meets the patterns by equality, so the work follows the texts, their shapes
    and the matches."""
    def shape(raw: Column) -> Column:
        return F.transform(F.split(raw, "_", -1), lambda r: F.char_length(r))

    def run_at(lt: Column, runs: Column) -> Column:
        """The characters of ``lt`` in the places of the literal runs, joined by ``_``."""
        start = lambda i: F.aggregate(F.slice(runs, 1, i), F.lit(1), lambda a, n: a + n + 1)
        return F.array_join(F.transform(runs, lambda n, i: F.substring(lt, start(i), n)), "_")

    asked = queries.select("query_id", "raw", shape(F.col("raw")).alias("shape"), F.char_length("raw").alias("len"))
    shapes = asked.select("shape", "len").distinct()
    masked = (texts.withColumn("len", F.char_length("lt")).join(checked_broadcast(shapes), "len")
              .select("id", "shape", run_at(F.col("lt"), F.col("shape")).alias("raw")))
    return asked.join(masked, ["raw", "shape"]).select("query_id", "id")


def _nested(lt: DataFrame, lq: DataFrame, match: Column) -> DataFrame:
    return lt.join(F.broadcast(lq.select("query_id", "lq")), match).select("query_id", "id")


def _wildcards_only(lt: DataFrame, lq: DataFrame, match: Column) -> DataFrame:
    """Patterns that any text of some length matches: the distinct ones, in
    blocks that are broadcast one after another, then joined to their queries."""
    distinct = lq.select("lq").distinct()
    n, size = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("lq")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_PATTERNS), -(-size // BROADCAST_BYTES))
    out = None
    for k in range(blocks):
        block = distinct.where(F.pmod(F.xxhash64("lq"), F.lit(blocks)) == k)
        hit = lt.join(F.broadcast(block), match).select("lq", "id")
        out = hit if out is None else out.unionByName(hit)
    return out.join(lq.select("query_id", "lq"), "lq").select("query_id", "id")


def _gram_probe(lt: DataFrame, lq: DataFrame, match: Column, n: int, probes_fit: bool) -> DataFrame:
    """``lq``: (query_id, lq, grams) with at least one gram, of n characters,
    per query. ``probes_fit``: the query table has at most ``BROADCAST_ROWS``
    rows and ``BROADCAST_BYTES`` of query text (counted by the caller), so one
    probe row per query can be broadcast."""
    q_grams = lq.select("query_id", F.explode("grams").alias("gram"))
    wanted = checked_broadcast(q_grams.select("gram").distinct())
    # (gram, id) for query grams only: the title side never shuffles
    # grams that no query asks for
    t_grams = lt.select("id", F.explode(_grams(F.col("lt"), n)).alias("gram")).join(wanted, "gram", "left_semi")
    gram_df = t_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("gdf"))
    rarest = top_n(q_grams.join(gram_df, "gram", "left").fillna(0, ["gdf"]), ["query_id"],
                   [F.col("gdf").asc(), F.col("gram").asc()], 1)
    probes = rarest.where(F.col("gdf") > 0).select("query_id", "gram").join(lq.select("query_id", "lq"), "query_id")
    if probes_fit:
        # one probe row per query (checked count): titles stream past the
        # broadcast probes and are verified in the same scan, never shuffled
        return (lt.select("id", "lt", F.explode(_grams(F.col("lt"), n)).alias("gram"))
                .join(F.broadcast(probes), "gram").where(match).select("query_id", "id"))
    cand = probes.select("query_id", "gram").join(t_grams, "gram")
    return (cand.join(lq.select("query_id", "lq"), "query_id").join(lt, "id")
            .where(match).select("query_id", "id"))


def substring_top(works: DataFrame, queries: DataFrame, limit: int = SEARCH_LIMIT,
                  wildcards: bool = False) -> DataFrame:
    """L4: at most ``limit`` substring hits per query, by id (ours; the
    reference gives no order)."""
    return top_n(substring_hits(works, queries, wildcards), ["query_id"], [F.col("id").asc()],
                 limit, rank_col="rank")
