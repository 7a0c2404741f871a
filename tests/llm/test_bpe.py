"""Byte-level BPE against the public library, and the prefix table's appends and edits against encoding anew."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import bpe

VOCABULARY = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={})
ENCODER = bpe.Encoder(VOCABULARY, public_tokenizers.PATTERN)
HARD = ["", " ", "  a  ", "don't 'LL we'll", "<|endoftext|>x", "é" * 50, "　 \x85\x1c\n\n\t", "日本語 한국어 ñandú", "🙂‍🙂 \U0010ffff", "a" * 3000, "ab" * 2000, "1234567890" * 30, "=" * 500, "\x00\x01", "the the the", "ÃÂÃÂÃÂ" * 20]
SCHEMA = "doc_id long, text string, ids string, bytes string, n_tokens string"


def test_hard_texts():
    for text in HARD:
        assert ENCODER.ids(text) == LIBRARY.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert ENCODER.ids(text) == LIBRARY.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeinrst'’ \né", max_size=80))
def test_frequent_letters(text):
    assert ENCODER.ids(text) == LIBRARY.encode_ordinary(text)
    assert bpe.PrefixTable(VOCABULARY).append(text.encode()).ids() == (LIBRARY._core_bpe.encode_single_piece(text.encode()) if text else [])


def test_a_small_vocabulary_with_a_token_out_of_reach():
    ranks = {bytes([c]): c for c in range(256)} | {b"bc": 256, b"ab": 257, b"abc": 258, b"aab": 259}
    library = tiktoken.Encoding("s", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    vocabulary = bpe.Vocabulary(ranks)
    encoder = bpe.Encoder(vocabulary, r"\S+|\s+")
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 12)))
        assert encoder.ids(text) == library.encode_ordinary(text), text


def test_prefixes_appends_and_edits_of_bytes():
    rng = random.Random(2)
    pick = lambda n: "".join(rng.choice("etaoin shrdlu'éß\n=") for _ in range(rng.randint(0, n))).encode()
    whole = lambda data: LIBRARY._core_bpe.encode_single_piece(data) if data else []
    for _ in range(60):
        table = bpe.PrefixTable(VOCABULARY).append(pick(300))
        table.append(pick(20)).append(pick(20))
        assert table.ids() == whole(table.data)
        k = rng.randint(0, len(table.data))
        assert table.ids(k) == whole(table.data[:k])
        for _ in range(5):
            start = rng.randint(0, len(table.data))
            end = min(len(table.data), start + rng.randint(0, 6))
            want = table.data[:start] + (new := pick(6)) + table.data[end:]
            table.replace(start, end, new)
            assert table.data == want and table.ids() == whole(want)
    table = bpe.PrefixTable(VOCABULARY).append(b"the cat sat on the mat and " * 2000)
    assert table.replace(100, 103, b"dog") < 400  # far from the 54 000 bytes there are
    assert table.ids() == whole(table.data)


def test_appends_and_edits_of_texts():
    rng = random.Random(3)
    pick = lambda n: "".join(rng.choice("aelrtv '  \n\t1é.s") for _ in range(rng.randint(0, n)))
    for _ in range(300):
        text = bpe.EncodedText(ENCODER, pick(60))
        for _ in range(6):
            now = text.text
            if rng.random() < 0.4:
                text.append(more := pick(4))
                want = now + more
            else:
                start = rng.randint(0, len(now))
                end = min(len(now), start + rng.randint(0, 5))
                want = now[:start] + (new := pick(5)) + now[end:]
                text.replace(start, end, new)
            assert text.text == want and text.ids() == LIBRARY.encode_ordinary(want), (now, want)
    text = bpe.EncodedText(ENCODER, "all cats are grey " * 3000)
    assert text.replace(30, 31, "x") < 20


def test_recent_matches_do_not_matter(monkeypatch):
    monkeypatch.setattr(bpe, "RECENT", 3)
    monkeypatch.setattr(bpe, "RECENT_PAIRS", 5)
    monkeypatch.setattr(bpe, "LONG", 40)
    monkeypatch.setattr(bpe, "BLOCK", 7)
    encoder = bpe.Encoder(VOCABULARY, public_tokenizers.PATTERN)
    texts = [*HARD, *(" ".join(HARD[:8]) for _ in range(3))]
    assert [x for p in encoder.packed_all(texts) for x in memoryview(p).cast("i")] == [x for t in texts for x in LIBRARY.encode_ordinary(t)]


def test_rows(spark):
    rng = random.Random(4)
    texts = [None, *HARD, " ".join(str(rng.random()) for _ in range(60_000)), "x" * 200_000, "same", "same"]
    rows = [(k // 2, t, "a", "b", "c") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = bpe.decoded(bpe.encoded(docs, VOCABULARY, public_tokenizers.PATTERN), VOCABULARY).collect()
    found = sorted((r["doc_id"], tuple(r["ids"]), bytes(r["bytes"])) for r in out)
    assert found == sorted((k, tuple(LIBRARY.encode_ordinary(t or "")), (t or "").encode()) for k, t, *_ in rows)
    none = spark.createDataFrame([], SCHEMA)
    assert bpe.decoded(bpe.encoded(none, VOCABULARY, public_tokenizers.PATTERN), VOCABULARY).collect() == []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query(spark, sf):
    out = {r["doc_id"]: r for r in bpe.op13_prefix_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(out) == len(docs)
    for doc_id, text in docs:
        ids = LIBRARY.encode_ordinary(text or "")
        r = out[doc_id]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
