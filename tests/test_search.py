"""Search routing, DOI matching and substring search."""

from paperweave.operators.search import substring_hits
from paperweave.plans.search import search

W = "id string, doi string, title string, publication_year int, cited_by_count int, " \
    "first_author string, venue string, abstract_inverted_index string"


def works(spark):
    rows = [("W1", "https://doi.org/10.1/a_b", "Deep learning for cats", 2001, 5, None, None, None),
            ("W2", "https://doi.org/10.1/axb", "Cats and dogs", 2002, 3, None, None, None),
            ("W3", "https://doi.org/10.1/c", "Learning to learn", 2003, 1, None, None, None),
            ("W4", "https://doi.org/10.1/d", None, 2004, 1, None, None, None)]
    return spark.createDataFrame(rows, W)


def q(spark, rows):
    return spark.createDataFrame(rows, "query_id long, q string")


def test_x6_doi_routes(spark):
    res = search(works(spark), q(spark, [(1, " HTTPS://DOI.ORG/10.1/A_B "), (2, "10.1/a_b"),
                                         (3, "ab"), (4, "https://doi.org/10.1/d")]))
    hits = res.hits.collect()
    by_q = {}
    for h in hits:
        by_q.setdefault(h.query_id, []).append(h)
    assert [(h.route, h.id) for h in by_q[1]] == [("doi", "W1")]
    assert all(h.route == "bm25" for h in by_q.get(2, []))      # bare DOI falls through
    assert 4 not in by_q or all(h.route == "bm25" for h in by_q[4])   # null title never returned
    assert [r.query_id for r in res.rejected.collect()] == [3]


def test_l1_bm25_order(spark):
    hits = search(works(spark), q(spark, [(1, "learning cats")])).hits.orderBy("rank").collect()
    assert [h.id for h in hits][:1] == ["W1"]                    # both terms
    assert {h.id for h in hits} == {"W1", "W2", "W3"}
    assert [h.rank for h in hits] == [1, 2, 3]


def test_substring_mode_and_wildcards(spark):
    res = search(works(spark), q(spark, [(1, "LEARN"), (2, "cats_"), (3, "a%d")]), mode="substring")
    got = sorted((h.query_id, h.id) for h in res.hits.collect())
    assert got == [(1, "W1"), (1, "W3")]
    res = search(works(spark), q(spark, [(2, "cats_"), (3, "s a%d")]), mode="substring", wildcards=True)
    got = sorted((h.query_id, h.id) for h in res.hits.collect())
    assert got == [(2, "W2"), (3, "W2")]


def test_trigram_path_equals_nested_loop(spark):
    qs = q(spark, [(1, "learn"), (2, "cats"), (3, "zzz"), (4, "ats and d"), (5, "ing")])
    a = sorted(tuple(r) for r in substring_hits(works(spark), qs).collect())
    b = sorted(tuple(r) for r in substring_hits(works(spark), qs, broadcast_rows=0).collect())
    assert a == b and len(a) == 7


def test_trigram_path_with_wildcards_and_short_queries(spark):
    # "s a%d": literal runs "s a" and "d"; "a%d" and "g_": no 3-character run
    # (nested loop part); "ca": short literal query (nested loop part)
    pats = q(spark, [(1, "cats_"), (2, "s a%d"), (3, "a%d"), (4, "g_"), (5, "learn%learn"), (6, "zz%zz")])
    a = sorted(tuple(r) for r in substring_hits(works(spark), pats, wildcards=True).collect())
    b = sorted(tuple(r) for r in substring_hits(works(spark), pats, wildcards=True, broadcast_rows=0).collect())
    assert a == b
    assert a == [(1, "W2"), (2, "W2"), (3, "W2"), (4, "W1"), (4, "W2"), (4, "W3"), (5, "W3")]
    # a backslash is literal: its pattern is escaped, its trigrams are not
    bs = spark.createDataFrame([("W9", None, "a\\b_c x", 1, 1, None, None, None)], W)
    for pat in (q(spark, [(1, "a\\b_"), (2, "\\b_c")]), q(spark, [(1, "a\\b%x")])):
        hits = {tuple(r) for r in substring_hits(bs, pat, wildcards=True, broadcast_rows=0).collect()}
        assert hits == {(i, "W9") for i in (1, 2)} & {(r.query_id, "W9") for r in pat.collect()}
    lits = q(spark, [(1, "ca"), (2, "ats"), (3, "to learn")])
    a = sorted(tuple(r) for r in substring_hits(works(spark), lits).collect())
    b = sorted(tuple(r) for r in substring_hits(works(spark), lits, broadcast_rows=0).collect())
    assert a == b == [(1, "W1"), (1, "W2"), (2, "W1"), (2, "W2"), (3, "W3")]


def test_strip_doi_prefix_option(spark):
    res = search(works(spark), q(spark, [(1, "10.1/A_B")]), strip_doi_prefix=True)
    assert [(h.route, h.id) for h in res.hits.collect()] == [("doi", "W1")]


def test_stopwords_option(spark):
    from paperweave.operators.search import build_title_index, bm25_top
    idx = build_title_index(works(spark), stopwords=["for", "and", "to"])
    assert idx.postings.where("term = 'for'").count() == 0
    hits = bm25_top(idx, q(spark, [(1, "cats and")])).collect()
    assert {h.id for h in hits} == {"W1", "W2"}


def test_trigram_path_against_brute_force(spark):
    # random titles and queries over a small alphabet with wildcard
    # characters, a backslash and an accented letter; the trigram equi-join
    # must return exactly the pairs a direct test finds
    import random
    import re
    rnd = random.Random(7)
    alphabet = "abAB c%_\\é"
    titles = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(60)]
    qtexts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 6))) for _ in range(40)]
    rows = [(f"W{i}", None, t, 1, 1, None, None, None) for i, t in enumerate(titles)]
    ws = spark.createDataFrame(rows, W)
    qs = q(spark, list(enumerate(qtexts)))

    def like(pattern, text):
        rx = "".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in pattern)
        return re.fullmatch(rx, text, re.S) is not None

    want_lit = {(i, f"W{j}") for i, qt in enumerate(qtexts) for j, t in enumerate(titles) if qt.lower() in t.lower()}
    want_pat = {(i, f"W{j}") for i, qt in enumerate(qtexts) for j, t in enumerate(titles)
                if like("%" + qt.lower() + "%", t.lower())}
    got_lit = {tuple(r) for r in substring_hits(ws, qs, broadcast_rows=0).collect()}
    got_pat = {tuple(r) for r in substring_hits(ws, qs, wildcards=True, broadcast_rows=0).collect()}
    assert got_lit == want_lit
    assert got_pat == want_pat
