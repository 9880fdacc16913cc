import random

import pytest

tiktoken = pytest.importorskip("tiktoken")

from codeweft.llm import encode  # noqa: E402
from codeweft.llm.tokenizer import BPE, PATTERN, RunEncoder, StreamDecoder, StreamEncoder  # noqa: E402


@pytest.fixture(scope="module")
def bpe():
    return BPE()


@pytest.fixture(scope="module")
def exact(bpe):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.ranks, special_tokens={}).encode_ordinary


PIECES = ["a", "the", " ing", "\n", "  ", "é", "中文", "'ll", "'", "12", "²", "==", "\u3000", "\r\n", "\t", "😀", "_x", "Ω", "don't", "\x1c"]


def test_random_texts_equal_the_public_encoder(bpe, exact):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(60))) for _ in range(200)] + ["", None, " ", "\n\n"]
    flat, ends = bpe.encode_batch(texts)
    counts = bpe.count_batch(texts)
    at = 0
    for t, end, n in zip(texts, ends, counts):
        want = exact(t or "")
        assert bpe.encode(t) == flat[at:end].tolist() == want and n == len(want)
        at = end


def test_streaming_equals_whole_and_decodes_back(bpe, exact):
    rng = random.Random(2)
    for _ in range(20):
        text = "".join(rng.choice(PIECES) for _ in range(200))
        run, ids, at = StreamEncoder(bpe), [], 0
        while at < len(text):
            n = rng.randrange(1, 30)
            ids += run.feed(text[at : at + n])
            at += n
        ids += run.finish()
        assert ids == exact(text)
        back = StreamDecoder(bpe)
        assert "".join(back.feed(ids)) + back.finish() == text


def test_one_endless_piece_needs_a_window_only(bpe, exact):
    text = "ab" * 2000 + "thequick" * 300
    run = RunEncoder(bpe)
    ids = run.feed(text.encode())
    assert len(run.data) <= 3 * bpe.longest + 1
    assert ids + run.finish() == exact(text)


def test_very_long_texts_go_through_the_transducer(bpe, exact):
    text = "word and more, " * 6000 + "z" * 70_000 + " 12" + "!" * 50
    assert bpe.encode(text) == exact(text) and bpe.count(text) == len(exact(text))


def test_corpus_keeps_rows(spark, exact):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encode.encode_corpus(df).collect())
    assert got == [(1, exact("a b")), (2, []), (3, []), (3, [])]
    assert {(r.doc_id, r.text) for r in encode.decode_corpus(encode.encode_corpus(df)).collect()} == {(1, "a b"), (2, ""), (3, "")}
    assert encode.encode_corpus(df.limit(0)).count() == 0
