"""What the findings of round 3 named: rows that are moved, and results where a step was bounded before."""

import io
import random
from contextlib import redirect_stdout

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.catalog import QUERIES
from textloom.operators import damage as D
from textloom.operators import fitting as T
from textloom.operators import graphs as G
from textloom.operators import measures as M
from textloom.operators import normal as N
from textloom.operators import repairs as R
from textloom.operators import sequences as S

from test_quoted import alike

DATA = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


def test_placed_blocks_moves_no_words(spark):
    assert "Exchange" not in plan(QUERIES["placed_blocks"](spark, DATA))


def test_token_profile_deals_texts(spark):
    assert "explode" not in plan(QUERIES["token_profile"](spark, DATA))


def test_stopword_language_moves_no_words(spark):
    shown = plan(QUERIES["stopword_language"](spark, DATA))
    assert "BroadcastHashJoin" in shown and "hashpartitioning(doc_id" in shown and "hashpartitioning(word" not in shown


def test_interpolated(spark):
    values = {"a": [float(k * k % 101) for k in range(500)], "b": [3.0], "c": [1.0, 2.5], None: [5.0, None, 7.0], "d": [None]}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    out = {r["k"]: r for r in M.interpolated(rows, ["k"], "v", [0.5, 0.95]).collect()}
    assert out.keys() == values.keys() - {"d"}
    for k, r in out.items():
        here = [v for v in values[k] if v is not None]
        assert r["n"] == len(here) and [r["q50"], r["q95"]] == pytest.approx([np.quantile(here, q) for q in (0.5, 0.95)])


def test_summary_stats_holds_no_group_of_values(spark):
    assert "percentile(" not in plan(QUERIES["summary_stats"](spark, DATA))


def test_packing_takes_lengths(spark):
    texts = ["aaaa", "bb", "ccc", "d"] * 3
    rows = spark.createDataFrame([(1, texts), (2, []), (3, None)], "id int, pieces array<string>")
    packed = rows.select("id", S.packed(F.col("pieces"), 8).alias("chunks"))
    assert "transform(" in plan(packed)
    assert {r["id"]: r["chunks"] for r in packed.collect()} == {1: S.pack([len(x) for x in texts], 8), 2: [], 3: None}


def test_placed_words_of_ascii_and_others():
    for text in ("It's 5 o'clock_now, A-B", "Ça—o’clock ﬁx It's", ""):
        found = N.placed_words(text)
        assert [text[a:b].lower().replace("’", "'") for _, a, b in found if text.isascii()] == [w for w, _, _ in found if text.isascii()]
    assert N.placed_words("Don't x") == [("don't", 0, 5), ("x", 6, 7)]


def test_normal_forms_come_back_as_digests(spark):
    assert "md5(" not in plan(QUERIES["normal_forms"](spark, DATA))


def test_tokens_are_counted_before_they_are_looked_at(spark):
    words = spark.createDataFrame([("h¤llo", 3), ("H¤llo", 2), ("plain", 9)], "token string, n long")
    assert [(r["token"], r["n"]) for r in D.welded(words, "token", "n").collect()] == [("h¤llo", 5)]


def test_window_likeness_is_that_of_all_windows(spark):
    rng = random.Random(1)
    words = ["a", "bé", "cat", "größe", "xyzzy", "mañana", "longerword" * 3]
    pairs = [(" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))), " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))) for _ in range(60)]
    assert max(len(q) for q, _ in pairs) > 128
    for (q, t), found in zip(pairs, R.window_likeness(pairs), strict=True):
        w, n = t.split(" "), len(q.split(" "))
        assert found == max((alike(q, " ".join(w[i : i + k])) for k in range(max(1, n - 2), n + 3) for i in range(len(w) - k + 1)), default=0.0)
    assert "levenshtein" not in plan(QUERIES["quote_scores"](spark, DATA))


def test_components_of_any_shape_by_stars(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000 + rng.randrange(80), 1000 + rng.randrange(80)) for _ in range(60)] + [(5000, 5000 + k) for k in range(1, 200)] + [(9, 9)]
    ids = [*range(310), *range(1000, 1090), *range(5000, 5205)]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    rng.shuffle(edges)
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7)
    out = G.components(spark.createDataFrame([(i,) for i in ids], "id long"), frame).collect()
    assert {r["id"]: r["component"] for r in out} == {i: find(i) for i in ids} and len(out) == len(ids)
    batch = pa.RecordBatch.from_pydict({"x": [k for k in range(100)], "y": [k + 1 for k in range(100)]})
    (star,) = G._stars(iter([batch]))
    assert star.to_pydict() == {"x": list(range(1, 101)), "y": [0] * 100}


def test_linkage_in_rounds_is_that_of_the_table(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 5)) + np.repeat(rng.normal(size=(15, 5)) * 2, 10, axis=0)
    x[140:] = x[3]  # copies
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = T.linkage(x, 0.3)
    rows = spark.createDataFrame([("b", k, v.tolist()) for k, v in enumerate(x)], "block string, id long, v array<double>")
    before, T.PART = T.PART, 40
    try:
        out = {r["id"]: r["cluster"] for r in T.linked_in_rounds(rows, 0.3, 60).collect()}
    finally:
        T.PART = before
    assert out == {k: int(np.flatnonzero(labels == labels[k])[0]) for k in range(150)} and 5 < len(set(out.values())) < 60


def test_a_block_beyond_one_table_is_clustered(spark):
    rows = spark.createDataFrame([(k % 2, k, [1.0, 0.0] if k % 4 < 2 else [0.0, 1.0]) for k in range(2 * T.MOST_IN_BLOCK + 4)], "b int, i long, v array<double>")
    out = T.average_linkage(rows, "b", "i", "v", 0.2).groupBy("cluster").count().collect()
    assert {r["cluster"] for r in out} == {0, 1, 2, 3} and sum(r["count"] for r in out) == 2 * T.MOST_IN_BLOCK + 4
