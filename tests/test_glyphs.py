"""Cut runs against character-wise cutting, and inferred signs on small vocabularies."""

import random

import pytest

from textloom.operators import damage as D
from textloom.operators import intervals as I


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(3)
    texts = [(k, "".join(rng.choice("abcdé🙂 ") for _ in range(rng.randint(0, 40)))) for k in range(80)] + [(80, None), (81, "")]
    cuts = [(k, lo, lo + rng.randint(-1, 9)) for k, t in texts if t is not None for lo in rng.choices(range(45), k=rng.randint(0, 5))]
    return texts, cuts, spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame(cuts, "k long, lo int, hi int")


def gone(cuts, key):
    return {i for k, lo, hi in cuts if k == key for i in range(lo, hi)}


def test_cut_texts(case):
    texts, cuts, t, c = case
    found = {r["k"]: r["text"] for r in I.cut_texts(t, c, "k").collect()}
    assert found == {k: x and "".join(ch for i, ch in enumerate(x) if i not in gone(cuts, k)) for k, x in texts}


def test_places_move_with_the_cuts(spark, case):
    texts, cuts, _, c = case
    points = [(k, at, at) for k, t in texts if t for at in range(len(t) + 1)]
    found = {(r["k"], r["was"]): r["at"] for r in I.moved(spark.createDataFrame(points, "k long, at int, was int"), c, ["k"], "at").collect()}
    assert found == {(k, at): sum(i not in gone(cuts, k) for i in range(at)) for k, at, _ in points}


def test_spans_stay_apart(spark):
    spans = spark.createDataFrame([("a", 0, 5), ("a", 5, 9), ("a", 12, 20), ("b", 0, 3)], "k string, lo int, hi int")
    cuts = spark.createDataFrame([("a", 14, 16), ("a", 15, 17), ("a", 2, 2), ("c", 0, 9)], "k string, lo int, hi int")
    out = sorted(tuple(r) for r in I.remaining(spans, cuts, ["k"]).select("k", "lo", "hi", "to").collect())
    assert out == [("a", 0, 5, 0), ("a", 5, 9, 5), ("a", 12, 14, 9), ("a", 17, 20, 11), ("b", 0, 3, 0)]


def test_many_cuts_in_one_text(spark):
    text = spark.createDataFrame([(1, "x" * 400_000)], "k long, text string")
    cuts = spark.range(100_000).selectExpr("1L as k", "cast(id * 4 as int) as lo", "cast(id * 4 + 2 as int) as hi")
    assert len(I.cut_texts(text, cuts, "k").first()["text"]) == 200_000


WORDS = {"affirmative": 3, "affine": 2, "official": 4, "british": 5, "brisk": 1, "said": 9, "bat": 5, "cat": 5, "skin": 2}


def table(spark, tokens):
    words = spark.createDataFrame(list(WORDS.items()), "word string, n long")
    return words, D.welded(spark.createDataFrame([(x,) for x in tokens], "token string"), "token")


def test_completions(spark):
    words, damaged = table(spark, ["a¤rmative", "a§ine", "%ritish", "%ritish", "*at", "s*in", "br*", "bri*k"])
    found = {r["token"]: r["fill"] for r in D.completions(words, damaged).collect()}
    # three letters are too many, "bat" and "cat" are as likely, "br" is too short, and "brisk" was seen once
    assert found == {"a§ine": "ff", "%ritish": "b", "s*in": "k"}


def test_substitutions(spark):
    words, damaged = table(spark, ["a§irmative", "a§ine", "o§icial", "%ritish", "#said", "#said"])
    found = {r["sign"]: (r["fill"], r["words"], r["sure"]) for r in D.substitutions(words, damaged).collect()}
    assert found == {"§": ("ff", 3, True), "%": ("b", 1, False)}
