"""Quotes in runs of cues and continuation signals against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import flows as L
from textloom.operators import repairs as R


def test_quote_ranges(spark):
    rng = random.Random(2)
    words = ["river", "stone", "garden", "winter", "candle", "mountain", "silver", "thunder", "yellow", "basket"]
    cues = [(k, n, " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))) for k in range(4) for n in range(11)]
    cues += [(9, 0, "the very same words stand here"), (9, 1, "between"), (9, 2, "the very same words stand here"), (9, 3, None)]
    text = lambda k: " ".join(t or "" for j, _, t in cues if j == k)
    quotes = [(9, "the very same words stand here"), (9, "very same words stand here between the very"), (9, "nothing like it at all"), (9, None), (7, "no cues")]
    for k in range(4):
        for _ in range(3):
            whole = text(k).split()
            at = rng.randrange(len(whole) - 6)
            quotes.append((k, " ".join(w if rng.random() < 0.8 else w[:-1] + "x" for w in whole[at : at + 6])))
    c, q = spark.createDataFrame(cues, "k int, n int, text string"), spark.createDataFrame(quotes, "k int, quote string")
    found = {(r["k"], r["quote"]): r["first"] is not None and (r["first"], r["last"], round(r["score"], 6)) for r in L.quote_ranges(q, c, "k", "n").collect()}
    runs = {k: [t or "" for j, _, t in cues if j == k] for k in {j for j, *_ in cues}}
    pairs = [(k, x, i, j, " ".join(runs[k][i : j + 1])) for k, x in quotes if x and k in runs for i in range(len(runs[k])) for j in range(i, min(len(runs[k]), i + 8))]
    scored = spark.createDataFrame(pairs, "k int, quote string, i int, j int, text string").withColumn("s", R.quote_score(F.col("quote"), F.col("text"))).collect()
    chosen = 0
    for k, x in quotes:
        good = [(r["s"], r["i"], r["j"], len(r["text"])) for r in scored if r["k"] == k and r["quote"] == x and r["s"] >= 0.65]
        want = False
        if good:
            s, i, j, _ = min(good, key=lambda r: (-r[0], r[2] - r[1], abs(r[3] - len(x)), r[1]))
            if not any((b < i or a > j) and abs(s - t) < 0.05 for t, a, b, _ in good):
                want = (i, j, round(s, 6))
        assert found[k, x] == want
        chosen += want is not False
    assert chosen >= 6 and found[9, "the very same words stand here"] is False


def brute(lines):
    pages = {}
    for book, page, *_, x0, x1 in lines:
        pages.setdefault((book, page), []).append((x0, x1))
    edges = {}
    for k, v in pages.items():
        lefts = [round(x) for x, _ in v]
        edges[k] = (min(set(lefts), key=lambda x: (-lefts.count(x), x)), sorted(x for _, x in v)[int(0.9 * (len(v) - 1))]) if len(v) >= 6 else None  # noqa: B023
    out, before = {}, {}
    for book, page, n, x0, x1 in sorted(lines):
        own, prev = edges[book, page], before.get(book)
        before[book] = (x1, edges[book, page])
        if own is None or prev is None or prev[1] is None:
            out[book, page, n] = "undecided"
            continue
        signals = (x0 > own[0] + 5, prev[0] < prev[1][1] - 8)
        out[book, page, n] = {(True, True): "new", (False, False): "continues"}.get(signals, "undecided")
    return out


def test_continuations(spark):
    rng = random.Random(3)
    lines = [(b, p, n, rng.choice([40.0, 40.4, 52.0]), rng.choice([400.0, 398.0, 380.0, 250.0])) for b in range(3) for p in range(6) for n in range(rng.choice([2, 5, 6, 30]))]
    df = spark.createDataFrame(lines, "book int, page int, n int, x0 double, x1 double").repartition(4)
    found = {(r["book"], r["page"], r["n"]): r["decision"] for r in L.continuations(df, "book", "page", ["n"]).collect()}
    assert found == brute(lines)
    assert {"new", "continues", "undecided"} == set(found.values())
    assert L.continuations(spark.createDataFrame([], df.schema), "book", "page", ["n"]).collect() == []


@pytest.mark.parametrize(("text", "quote", "score"), [("a b", "zz", 0.0)])
def test_short_quotes(spark, text, quote, score):
    c, q = spark.createDataFrame([(1, 1, text)], "k int, n int, text string"), spark.createDataFrame([(1, quote)], "k int, quote string")
    assert L.quote_ranges(q, c, "k", "n").first()["first"] is None
