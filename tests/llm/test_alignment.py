"""Cross-tokenizer alignment against a brute-force version with the public libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from textloom.llm import alignment

A = alignment.ByteLevel(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
B = alignment.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
LIBRARY_A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY_A.encode_special_tokens = True
LIBRARY_B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, row string, block string, side string, pairs string, n_a string"
SF = "/root/testdata/sf0.001"


def tokens_of(text):
    """(id, begin, end) lists of both sides, found by the libraries; empty if the bytes are not those of space + text."""
    if not text:
        return [], []
    whole, out = b" " + text.encode(), []
    ids = LIBRARY_A.encode(" " + text, add_special_tokens=False).ids
    out.append([(i, A.tokens[i]) for i in ids])
    pieces = LIBRARY_B.encode(text, out_type=str)
    out.append([(LIBRARY_B.piece_to_id(p), bytes([int(p[3:5], 16)]) if LIBRARY_B.is_byte(LIBRARY_B.piece_to_id(p)) else p.replace("▁", " ").encode()) for p in pieces])
    if any(b"".join(t for _, t in side) != whole for side in out):
        return [], []
    placed = []
    for side in out:
        at, spans = 0, []
        for i, t in side:
            spans.append((i, at, at + len(t)))
            at += len(t)
        placed.append(spans)
    return placed


def brute(rows):
    per, counts = [], Counter()
    for doc_id, text in rows:
        a, b = tokens_of(text)
        links, j0 = [], 0
        for x, s, e in a:
            while j0 < len(b) and b[j0][2] <= s:
                j0 += 1
            j = j0
            while j < len(b) and b[j][1] < e:
                links.append((x, b[j][0]))
                j += 1
        common = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, ia, ib = [], 0, 0
        for c in common:
            ga, gb = [], []
            while ia < len(a) and a[ia][2] <= c:
                ga.append(str(a[ia][0]))
                ia += 1
            while ib < len(b) and b[ib][2] <= c:
                gb.append(str(b[ib][0]))
                ib += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        counts.update(links)
        text_ = ";".join(groups)
        per.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(text_.encode()).hexdigest() if a else "", text_))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(d, na, nb, ng, len(ls), sum(counts[p] == best[p[1]] for p in ls), sum(counts[p] for p in ls), sha) for d, na, nb, ng, ls, sha, _ in per], {(d, t) for d, *_, t in per}


def corpus():
    rng = random.Random(3)
    words = "the of and don't naïve tokenisation 12345 日本語 🙂 <s> <|endoftext|>   … straße ---- aaaaaaa".split(" ")
    texts = [None, "", " ", "  a  b ", "x", "\n", "a\tb\r\n", "has ▁ inside", "<s></s><unk>", "\x00", "é", "aaaaaaaaaaaaaaaaaaaa" * 10, "日本語" * 50, "same text", "same text", "same text"]
    texts += ["".join(rng.choice([" ", "\n", ""]) + rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    return [(k // 2 if k < 8 else k, t) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def framed(spark, rows):
    return spark.createDataFrame([(k, t, *"abcde") for k, t in rows], SCHEMA).repartition(3)


def found(df):
    return sorted(map(tuple, df.collect()))


def test_rows(spark, rows):
    assert found(alignment.aligned(framed(spark, rows), A, B)) == sorted(brute(rows)[0])


def test_blocks_and_parts_do_not_matter(spark, rows, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 7)
    monkeypatch.setattr(alignment, "PAIRS", 5)
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 3)
    assert found(alignment.aligned(framed(spark, rows), A, B)) == sorted(brute(rows)[0])


def test_groups_themselves(spark, rows):
    out = alignment.sweep(alignment.events(framed(spark, rows), A, B), A, B, text=True).collect()
    assert {(r["doc_id"], r["groups"]) for r in out} == brute(rows)[1]


def test_long_texts(spark):
    rng = random.Random(5)
    texts = ["a" * 150_000, " ".join(str(rng.random()) for _ in range(20_000)), "é" * 100_000, "word " * 60_000]
    rows = list(enumerate(texts))
    assert found(alignment.aligned(framed(spark, rows), A, B)) == sorted(brute(rows)[0])


def test_an_empty_table(spark):
    assert alignment.aligned(spark.createDataFrame([], SCHEMA), A, B).collect() == []


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    out = alignment.op12_event_sweep(spark, SF)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert found(out) == sorted(brute([tuple(r) for r in docs])[0])
