"""Edit lists, sentences, chunks, normal forms and repairs on literal cases."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators import chunking as C
from textloom.operators import normal as N
from textloom.operators import repairs as R
from textloom.operators import sequences as S


def test_sentence_ends():
    yes = ["She left.", "Did he?", "(She left.)", "so it ended.7", "so it ended.²", "“Stop.”", "in 1812."]
    no = ["She left", "ask Dr.", "by A.", "see vol.", "about 2.71", "dazu bzw.", ""]
    assert all(map(C.ends_sentence, yes)) and not any(map(C.ends_sentence, no))
    assert C.sentences("Mr. Li left. He was 3.5 m tall.12 Then J. S. came! \u201cGo.\u201d Ok") == ["Mr. Li left.", "He was 3.5 m tall.12", "Then J. S. came!", "“Go.”", "Ok"]


def test_units():
    lines = ["One is here.", "Two is there.", "Three is near.", "Four."]
    assert C.line_units(lines, 27) == [(0, 2), (2, 4)] and C.line_units(lines, 5) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert C.line_units(["some words inter-", "national law.", "End."], 18) == [(0, 2), (2, 3)]
    assert C.joined_lines(["inter-", "national", " law "]) == "inter-national law"
    assert C.sentence_units(["Aa bb.", "Cc.", "one two three four five", "Six."], 12) == ["Aa bb. Cc.", "one two", "three four", "five Six."]
    long = "first clause of it, second clause of it; " * 4 + "end"
    assert " ".join(C.capped(long, 60)) == long and max(map(len, C.capped(long, 60))) <= 60 + C.SHORT_PIECE


@settings(max_examples=60, deadline=None)
@given(st.text("ab. \n", max_size=200), st.integers(1, 40))
def test_chunks_are_the_text(text, size):
    for way in (C.break_point, lambda x, target, _: C.chapter_break(x, target)):
        assert "".join(C.cut_text(text, size, way)) == text


def test_chunks_of_documents(spark):
    """The query's cut points against the rules tried at every cut: the best kind of break in reach, at its last place."""
    from textloom.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").filter("text is not null").select("doc_id", "text").collect())
    for r in QUERIES["text_chunks"](spark, sf).collect():
        text = texts[r["doc_id"]]
        for ends in (r["rewriting"], r["translating"]):
            assert (ends[-1:] == [len(text)] or not text) and all(0 < b - a <= 1202 for a, b in zip([0, *ends], ends, strict=False))
        at = 0
        for end in r["rewriting"]:
            part = text[max(at, at + 1200 - C.BREAK_WINDOW) : at + 1200]
            if at + 1200 < len(text):
                kinds = [lambda i: text[:i].endswith("\n\n"), lambda i: i < at + 1200 and text[i - 1] in ".!?" and text[i] in " \n\r\"'“”‘’", lambda i: text[i - 1] == "\n", lambda i: text[i - 1] == " "]
                places = range(at + 1200 - len(part) + 1, at + 1201)
                best = next((found[-1] for kind in kinds if (found := [i for i in places if kind(i)])), at + 1200)
                assert end == best
            at = end


def test_break_points():
    assert C.break_point("one two.\n\nthree four. five", 20, 0) == 10
    assert C.break_point("one two. three four", 15, 0) == 8 and C.break_point("one\ntwo three", 9, 0) == 4
    assert C.break_point("one two", 5, 0) == 4 and C.break_point("x" * 9, 5, 0) == 5
    assert C.chapter_break("aa. bb\nChapter 2 cc", 18) == 6 and C.chapter_break("aa\n\nbb. cc", 9) == 4


def test_json_in_replies():
    assert C.balanced('x {"a": "}", "b": {"c": "\\\\\\""}} {', "{}") == '{"a": "}", "b": {"c": "\\\\\\""}}'
    assert C.balanced("[1, [2], 3", "[]") is None and C.balanced("no", "{}") is None and C.balanced('["open]', "[]") is None
    assert C.unfenced("<think>[1]</think> So:\n```json\n[2]\n``` bye") == "[2]"


def test_normal_forms():
    assert N.plain("Don’t  ﬁght, ‘co\u00adop’ É") == "don't fight coop"
    text = "It’s  Ａ co\u00adop 'x' end."
    plain, places = N.plain_with_places(text)
    assert plain == "it's a coop x end" and len(places) == len(plain) and text[places[5]] == "Ａ" and text[places[-1]] == "d"
    assert N.bare_words("Éa-b Ｃ ñ1") == ["ea", "b", "c", "n1"] or N.bare_words("Éa-b ñ1") == ["ea", "b", "n1"]
    assert N.emitted(" e\u0301 ﬁn\n x ") == "é fin x"
    words = N.placed_words("Ça—o’clock ﬁx")
    assert words == [("ça", 0, 2), ("o'clock", 3, 10), ("fix", 11, 13)]


def test_column_rules(spark):
    one = lambda c, *values: spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(c).first()[0]
    a, b = F.col("c0"), F.col("c1")
    assert one(R.edge_marks_restored(a, b), '"Tt could be, does."', "It could be, does") == '"It could be, does."'
    assert one(R.edge_marks_restored(a, b), "x y", "x y") == "x y" and one(R.edge_marks_restored(a, b), "", "x") == "x"
    assert one(R.edges_clamped(a, b), "murs of the neede", "Murmurs of the needed") == "murs of the neede"
    assert one(R.edges_clamped(a, b), "a b", "c d") == "c d"
    assert one(R.hyphen_repaired(a, b, True), "so extraordi-", "so extraordinary") == "so extraordi-"
    assert one(R.hyphen_repaired(a, b, False), "nary thing", "extraordinary thing") == "nary thing"
    assert one(R.hyphen_repaired(a, b, True), "so other-", "so extraordinary") is None
    assert one(R.glyph_damaged(a, b), "Different", "Di#erent") and not one(R.glyph_damaged(a, b), "can't", "can't stop")
    assert one(R.separators(a, b), "inter-", "national") == "\n" and one(R.separators(a, b), "so-", "Called") == " "
    quote = "the quick brown fox jumps over the lazy dog and then it sleeps for hours"
    assert one(R.quote_score(a, b), "Brown, fox!", quote) == 1 and one(R.quote_score(a, b), quote[:52] + " zz", quote) == 0.96
    assert one(R.quote_score(a, b), quote[:30] + "xx", quote) == 0.92 and one(R.quote_score(a, b), "a", quote) == 0
    assert one(R.quote_score(a, b), "brwn fox jumps", quote) == pytest.approx(1 - 1 / 15)
    assert one(R.vowel_share(F.split(a, " ")), "strength rhythms good to") == pytest.approx(1 / 3)
    assert one(R.without_stops(a), "Dr. No of the U.S. and U.S.A., e.g. no. 5") == "Dr No of the US and USA., eg no 5"
    entries = [("Intro ..... 7", ("Intro", 7)), ("Wide    12", ("Wide", 12)), ("Prologue 1", ("Prologue", 1)), ("abc 1", ("abc 1", None)), ("Just words", ("Just words", None))]
    for line, wanted in entries:
        assert tuple(one(R.toc_entry(a), line)) == wanted
    assert one(R.toc_entry(a), "x") is None


def test_rising_ties():
    rng = random.Random(5)
    for _ in range(200):
        v = [rng.randrange(6) for _ in range(rng.randrange(9))]
        early, late = S.rising_indices(v, True), S.rising_indices(v)
        assert len(early) == len(late) and all(v[a] < v[b] for x in (early, late) for a, b in zip(x, x[1:], strict=False))
        assert all(a <= b for a, b in zip(early, late, strict=True))
