import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuemill.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ENC = bpe.encoder(bpe._ranks(bpe.DEFAULT_RANKS))
THEIRS = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ENC.ranks, special_tokens={})
HARD = ["", " ", "  ", "a", "it's", "it's we're they'll I'd 'tis ''s ?'s 's'S", " 's x", "\n's", "a  b\n\n c \t", "x\n", "  x  ", "1a2 b'", "don'", "'", "'re", "'r", "é  ü　日本語。 z", "👩‍👧 नमस्ते", "<|endoftext|>", "a" * 3000, " " * 500 + "x", "ab'd've'll"]


def test_same_ids_on_hard_cases():
    got, offsets = ENC.encode(HARD)
    assert got == [THEIRS.encode_ordinary(x) for x in HARD]
    assert [len(a) for a in got] == [len(a) for a in offsets]
    assert [ENC.decode(x) for x in got] == HARD


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'strevld 1\n\t.?é日 ")), max_size=6))
def test_same_ids_as_a_regex_tokenizer(texts):
    assert ENC.encode(texts)[0] == [THEIRS.encode_ordinary(x) for x in texts]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_round_trip(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ENC.decode(ENC.encode([text])[0][0]) == text


def test_scan_does_not_depend_on_texts_beside():
    many = HARD * 40
    assert ENC.encode(many)[0] == ENC.encode(HARD)[0] * 40


def test_column(spark):
    rows = [(1, "it's me", "x"), (2, "", "y"), (3, None, None), (3, None, None), (4, "word " * 5000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encode(df, "text", ["doc_id"]).collect()}
    assert got == {1: THEIRS.encode_ordinary("it's me"), 2: [], 3: [], 4: THEIRS.encode_ordinary("word " * 5000)}
    counts = sorted((r.doc_id, r.n_tokens) for r in bpe.count_tokens(df, "text", ["doc_id"]).collect())
    assert counts == [(1, len(got[1])), (2, 0), (3, 0), (3, 0), (4, len(got[4]))]
    assert bpe.encode(df.limit(0), "text", ["doc_id"]).count() == 0


def test_blocks_compose(monkeypatch):
    text = "it's  a\n\ntest we'll 've see 12 3'd " * 50
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts = bpe.piece_starts(cp, np.array([0]))
    import regex

    assert starts.tolist() == [m.start() for m in regex.finditer(PATTERN, text)]
