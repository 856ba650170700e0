"""SentencePiece encoding and section token counts, against the libraries."""

import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb
from tokenizers import Tokenizer

from paperweave.llm.queries import QUERIES, TOKENIZERS
from paperweave.llm.sentencepieces import Encoder, Pieces, decode, encode
from paperweave.llm.token_counts import attribute, section_token_counts

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_encoding_equals_the_library(docs, rows, library):
    got = encode(docs, MODEL, check_col="same").collect()
    assert Counter((r.doc_id, r.text, tuple(r.ids)) for r in got) == Counter(
        (r[0], r[1], tuple(library.encode(r[1] or ""))) for r in rows)
    assert all(r.same for r in got if "▁" not in (r.text or "")) and got[0].c0 == "clash"


def test_random_strings(library):
    rnd = random.Random(1)
    texts = ["".join(rnd.choices("abcdeinrstoué ▁\n\t 中梦😀AKI01'.,-=x", k=rnd.randrange(60))) for _ in range(1500)]
    texts += ["x" * 70_000 + " y", "ab" * 40_000, "", " ", "  a", "a ", "a" * 3000, " " * 3000, "ab" * 2000]
    encoder = Encoder(Pieces(open(MODEL, "rb").read()))
    ids, at = encoder(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == library.encode(texts)
    assert [b.decode() for b in encoder.pieces.decode(ids, at)] == library.decode(library.encode(texts))


def test_words_are_kept_within_bounds(monkeypatch, library):
    import paperweave.llm.sentencepieces as s
    monkeypatch.setattr(s, "CACHED_WORDS", 3)
    encoder = Encoder(Pieces(open(MODEL, "rb").read()))
    for text in ("one two three four five", "six one two", "seven"):
        assert encoder([text])[0].tolist() == library.encode(text)


def test_unigram_model_takes_the_best_sum():
    """The same pieces as a unigram model: our best sums equal the library's."""
    m = pb.ModelProto()
    m.ParseFromString(open(MODEL, "rb").read())
    m.trainer_spec.model_type = 1
    rnd = random.Random(2)
    for p in m.pieces:
        if p.type == 1:
            p.score = -rnd.uniform(3, 15)
    library = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    encoder = Encoder(Pieces(m.SerializeToString()))
    texts = ["".join(rnd.choices("abcdeinrst oué中", k=rnd.randrange(1, 40))) for _ in range(500)]
    ids, at = encoder(texts)
    score = [p.score if p.type == 1 else 0 for p in m.pieces]
    for i, t in enumerate(texts):
        ours, theirs = ids[at[i]:at[i + 1]].tolist(), library.encode(t)
        assert ours == theirs or abs(sum(score[x] for x in ours) - sum(score[x] for x in theirs)) < 1e-3


def test_decoding(spark, docs, empty):
    coded = encode(docs, MODEL).select("doc_id", F.col("text").alias("was"), "ids", "c0")
    for r in decode(coded, MODEL).collect():
        assert r.text == (r.was or "").replace("▁", " ") or (r.was or "").startswith("▁")
    odd = spark.createDataFrame([(None,), ([],), ([3 + 0xFF],)], "ids array<int>")
    assert [r.text for r in decode(odd, MODEL).collect()] == ["", "", "�"]
    assert encode(empty, MODEL).count() == 0 and decode(encode(empty, MODEL), MODEL).count() == 0


def test_query_round_trips(spark):
    got = QUERIES["op2_sentencepiece_viterbi"](spark, SF)
    assert got.where("not round_trip or n_ids != size(ids)").count() == 0 and got.count() == 200


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def sections(t):
    """Lines with their line breaks; an empty text is one section."""
    out = t.split("\n")
    return [x + "\n" for x in out[:-1]] + ([out[-1]] if out[-1] or len(out) == 1 else [])




def test_section_counts_equal_the_library(docs, rows, tokenizer):
    """Starts of tokens by character offsets of another library; texts in which
    no token starts inside a character."""
    got = Counter()
    for r in section_token_counts(docs, RANKS).collect():
        got[r.doc_id, r.section, r.char_start, r.char_end, r.n_tokens] += 1
    want = Counter()
    for d, t, *_ in rows:
        t = t or ""
        offsets = [a for a, _ in tokenizer.encode(t, add_special_tokens=False).offsets]
        at = 0
        for k, x in enumerate(sections(t)):
            want[d, k, at, at + len(x), sum(at <= o < at + len(x) for o in offsets)] += 1
            at += len(x)
    assert got == want


def test_rules_agree_on_totals_and_share_crossing_tokens(spark):
    texts = ["a\n\n\nb", "x\n \n y", "", "\n", "plain", None, "é\n中\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    totals = {}
    for rule in ("start", "end", "share"):
        got = section_token_counts(df, RANKS, rule=rule).collect()
        totals[rule] = {}
        for r in got:
            totals[rule][r.doc_id] = totals[rule].get(r.doc_id, 0) + r.n_tokens
        assert rule != "start" or any(r.n_crossing for r in got)
    assert totals["start"] == totals["end"] and all(abs(totals["share"][k] - v) < 1e-9 for k, v in totals["start"].items())
    with pytest.raises(ValueError):
        section_token_counts(df, RANKS, rule="other")


def test_attribution_by_hand():
    edges, bounds = np.array([0, 2, 5, 6, 9]), np.array([0, 3, 4, 4, 9])
    assert attribute(edges, bounds, "start")[0].tolist() == [2, 0, 0, 2]
    assert attribute(edges, bounds, "end")[0].tolist() == [1, 0, 0, 3]
    n, crossing = attribute(edges, bounds, "share")
    assert np.allclose(n, [1 + 1 / 3, 1 / 3, 0, 1 / 3 + 2]) and crossing.tolist()[0] == 1 and crossing.tolist()[3] == 1


def test_empty_tables(empty):
    assert section_token_counts(empty, RANKS).count() == 0


def test_long_white_space_encodes_as_the_library_does(monkeypatch):
    import paperweave.llm.token_counts as tc
    with open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        encoder = tc._encoder(f.read())
    for long in (2, 7, 50):                                   # as if such short runs were too long
        monkeypatch.setattr(tc, "LONG", long)
        monkeypatch.setattr(tc, "LONG_SPACE", tc.re.compile(tc.LONG_SPACE.pattern.split("{")[0] + "{%d,}" % long))
        for gap in (" " * 60, "\n \n" * 20, "　\xa0\t" * 9, " " * 3, "\n", "\x85  "):
            for text in (gap, "a" + gap, gap + "a", "a" + gap + "b" + gap + "'s " + gap + "12", gap + "!" + gap):
                assert tc.encode_whole(encoder, text) == encoder.encode_ordinary(text)
    monkeypatch.undo()
    for text in (" " * 2_000_000, "\n " * 1_000_000 + "end", "x" * 2_000_000):
        assert b"".join(map(encoder.decode_single_token_bytes, tc.encode_whole(encoder, text))) == text.encode()


def test_fields_as_sections(spark):
    from paperweave.llm.token_counts import section_token_counts
    rows = spark.createDataFrame([(1, "a title", "and its body, longer"), (2, None, "body"), (3, "", None), (4, "é x", "中文")], "doc_id int, title string, body string")
    got = {(r.doc_id, r.section): r for r in section_token_counts(rows, f"{TOKENIZERS}/byte_bpe_50k.tiktoken", fields=["title", "body"]).collect()}
    whole = section_token_counts(rows.selectExpr("doc_id", "replace(concat(coalesce(title, ''), coalesce(body, '')), '\\n', ' ') AS text"),
                                 f"{TOKENIZERS}/byte_bpe_50k.tiktoken").groupBy("doc_id").sum("n_tokens").collect()
    assert len(got) == 8 and (got[1, 0].char_end, got[1, 1].char_start, got[1, 1].char_end) == (7, 7, 27)
    assert {d: got[d, 0].n_tokens + got[d, 1].n_tokens for d in (1, 2, 3, 4)} == {r[0]: r[1] for r in whole}
    assert (got[2, 0].n_tokens, got[3, 0].n_tokens, got[3, 1].n_tokens) == (0, 0, 0) and got[4, 1].char_end == 5
