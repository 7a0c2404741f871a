"""Footnotes, markers, groups, runs and aligned texts on literal cases and against plain restatements."""

import random
import re

from pyspark.sql import functions as F

from textloom.operators import alignment as A
from textloom.operators import markers as M


def test_chains_are_removed_and_others_spared(spark):
    rows = [("One.1 Two.2 Three.211 Four.4 end",), ("Only.1 two.2",), ("Late.5 On.6 And.7 on",), ("No numbers.",), ("In 1999. 40 percent",)]
    df = spark.createDataFrame(rows, "text string").withColumn("s", M.selected(F.col("text"))).select("text", "s.*")
    out = df.select(M.trusted(F.col("values"), F.col("chain")), M.without_chain(F.col("text"), F.col("chain")), "values").collect()
    assert [bool(r[0]) for r in out] == [True, False, False, False, False]
    assert out[0][1].startswith("One. Two. Three.") and out[0][2] == [1, 2, 211, 4]
    assert [r[0] for r in df.select(M.trusted(F.col("values"), F.col("chain"), restarts=False)).collect()][2]
    assert out[3][1] == "No numbers."


def test_structural_markers_have_their_context():
    found = M.structural_markers('<p>A long enough sentence.<sup><a href="#n">9</a></sup> Next to it, th<sup>th</sup> then more.<sup>12, 13</sup></p>')
    assert [m["value"] for m in found] == ["9", "12,13"]
    assert found[0]["context"] == " A long enough sentence." and found[1]["context"].endswith("then more.")
    assert M.structural_markers("<p>Short.<sup>1</sup></p>") == [] and M.structural_markers(None) == []


def test_placements_match_a_search_of_each_marker():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["the end of it.", "another line,", "1", "12", " ", "\n"]) for _ in range(40))
        markers = [{"context": "the end of it.", "value": "1"}, {"context": "another line,", "value": "12"}, {"context": "nd of it. 1 the end of it.", "value": "12"}]
        plain = []
        for m in markers:
            context = r"\s+".join(map(re.escape, m["context"].split()))
            plain.append(len(re.findall(rf"(?={context}\s?{m['value']}(?![0-9]))", re.sub(r"\s+", " ", text))))
        assert M.placements(markers, text) == plain


def test_block_groups():
    assert M.group_numbers(["p"] * 9, [10] * 9) == [0] * 8 + [1]
    assert M.group_numbers(["h1", "p", "H2", "h3", "p", "p"], [5] * 6) == [-1, 0, -1, -1, 1, 1]
    assert M.group_numbers(["p", "p", "p"], [3000, 1000, 1]) == [0, 0, 1]
    assert M.group_numbers(["p", "p"], [9000, 1]) == [0, 1] and M.group_numbers([], []) == []


def test_aligned_pairs():
    assert A.aligned_pairs("abc@ef", "abcdef") == [("abcef", "abcdef")]
    assert A.aligned_pairs("one xx two", "one ## two") == [("one", "one"), ("two", "two")]
    long = "w" * 59 + ". And then"
    assert A.aligned_pairs(long, long) == [("w" * 59 + ".",) * 2, ("And then",) * 2]
    assert A.aligned_pairs("", "") == A.aligned_pairs("ab", "ab") == []


def test_diagonal_pairs():
    assert A.diagonal_pairs(["the", "house", "stood"], ["thc", "stood"]) == [(2, 1)]
    assert A.diagonal_pairs(["house"] * 2, ["housc", "house"]) == [(0, 1), (1, 0)]
    assert A.diagonal_pairs(["w"] + ["x"] * 5, ["y"] * 5 + ["w"]) == [] and A.diagonal_pairs([], ["a"]) == []


def test_cues_end_with_sentences_or_length():
    assert A.cue_numbers(["One", "two.", "Three?)", "four"]) == [0, 0, 1, 2]
    assert A.cue_numbers(["w" * 119] * 3) == [0, 0, 1] and A.cue_numbers([]) == []


def test_edges_restored():
    assert A.edges_restored("a b c d e", "b c d") == "a b c d e"
    assert A.edges_restored("x y z b c d", "b c d") == "b c d"
    assert A.edges_restored("candlesti burns", "candlestick burns") == "candlestick burns"
    assert A.edges_restored("", "b") == "b" and A.edges_restored("a", "") == ""


def test_packed_runs():
    assert A.packed_runs([(0, 3), (4, 6), (20, 30)], 5, 10) == [(0, 6), (20, 30)]
    assert A.packed_runs([(0, 25)], 6, 10) == [(0, 10), (10, 25)]
    assert A.packed_runs([(0, 2), (40, 41)], 5, 10) == [(0, 41)] and A.packed_runs([], 5, 10) == []
