"""Findings of round 4: texts whose words stay in their row, against the operators on rows of words."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom import catalog
from textloom.operators import drift as D
from textloom.operators import editing as E

EDITS = ["edit_derivation", "edit_statuses", "guard_policies", "word_runs"]


def steps(df):
    """The operators of the plan that sort, join or exchange rows."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return [line for line in plan.split("\n") if any(x in line for x in ("Exchange", "Sort", "Window", "Join"))]


def told(rng, vocabulary, n):
    """A text of n words with marks, capitals and signs between them."""
    return "".join(rng.choice(vocabulary) + rng.choice([" "] * 12 + [". ", "! ", "?", "\n", " 12 ", ", "]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(41)
    out = [(k, told(rng, [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(size)], n)) for k, (size, n) in enumerate([(3, 400), (20, 300), (400, 3000), (600, 900), (600, 5), (600, 2), (30, 0)])]
    # a long run of short words after long ones moves the cues; odd texts
    out += [(10, "Incomprehensibilities notwithstanding. " * 60 + "Go to a. We do it. " * 200), (11, "..."), (12, "no mark at all"), (13, " 1 2 3 . 4 ! "), (14, "a b c." * 40), (15, "ΑΣ ΒΓ ΔΕ. Wort ß ïj İx y z!"), (16, "")]
    return [*out, (17, None), (None, "The cat sat on the mat. A bird sang.")]


def test_audited_texts_are_audited_as_rows(spark, texts):
    rate = 2.5
    df = spark.createDataFrame(texts, "k long, text string").repartition(3)
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), F.lit(0))
    stream = df.filter("text <> ''").select("k", F.posexplode(words(F.col("text"))).alias("pos", "word")).withColumn("at", F.col("pos") / rate)
    found = {(r["k"], r["sent"]): (r["start"], r["status"], r["offset"], r["moved_to"]) for r in D.audited_texts(df, "k", rate).collect()}
    # the cues by a plain count
    counted, rows = {r["k"]: r["n"] for r in df.select("k", F.size(words(F.col("text"))).alias("n")).collect()}, []
    for k, text in texts:
        at = 0
        for sent, piece in enumerate(re.split("[.!?]", text) if text else []):
            rows.append((k, sent, at / len(text) * (counted[k] / rate), piece))
            at += len(piece) + 1
    sents = spark.createDataFrame(rows, "k long, sent int, start double, piece string").withColumn("words", words(F.col("piece")))
    wanted = {(r["k"], r["sent"]): (r["start"], r["status"], r["offset"], r["moved_to"]) for r in D.audited(sents, stream, "k", rate).collect()}
    assert found == wanted
    assert {v[1] for v in wanted.values()} == {"short", "unheard", "ambiguous", "moved", "kept"}
    assert found[None, 0][1] == "unheard"


def test_audited_words_stay_in_their_row(spark, tmp_path):
    from textloom.plans import drifting, registry

    spark.createDataFrame([(1, "The cat sat on the mat. A bird sang in the tree today.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = steps(drifting.read_out(registry.Tables(spark, str(tmp_path))))
    assert len(found) == 1 and "REPARTITION_BY_NUM" in found[0]


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Documents with odd lines, and the folder that holds them."""
    rng = random.Random(43)
    words = ["the", "thc", "nde", "hand", "handed", "me", "rne", "m", "mm", "a", "", "→", "->", "löme", "summer", "so", "on"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, "\n".join(line(rng.choice([0, 1, 2, 3, 8, 30, 120])) for _ in range(rng.randint(1, 12)))) for k in range(60)]
    rows += [(60, ""), (61, "\n\n"), (62, None), (63, "the"), (64, line(3000)), (65, " ".join(f"w{k} thex" for k in range(400)) + "\nme\n"), (66, "them\r\nthe thc"), (67, "x" * 90 + "the " + "y" * 90)]
    rows += [(k, "\n".join(" ".join(["plain"] * 4 + [f"k{k}", "the", f"n{i}", "words", "here", "summer"]) for i in range(9))) for k in range(70, 80)]
    folder = str(tmp_path_factory.mktemp("lines"))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return rows, folder


@pytest.mark.parametrize("name", EDITS)
def test_odd_lines_as_the_sql_has_them(spark, lines, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{lines[1]}/documents.parquet/*.parquet'")
    cursor = con.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    key = lambda row: tuple(map(str, row))
    found = sorted((tuple(r[c] for c in columns) for r in catalog.QUERIES[name](spark, lines[1]).collect()), key=key)
    assert found and found == sorted(cursor.fetchall(), key=key)


@pytest.mark.parametrize("name", EDITS)
def test_words_of_lines_stay_in_their_row(spark, lines, name):
    """Texts are exchanged once; besides that only what is counted."""
    found = steps(catalog.QUERIES[name](spark, lines[1]))
    assert sum("REPARTITION_BY_NUM" in line for line in found) == 1
    assert all("Exchange hashpartitioning" in line for line in found) and len(found) <= 2


@pytest.mark.parametrize("name", EDITS)
def test_runs_are_found_once(spark, lines, name):
    plan = catalog.QUERIES[name](spark, lines[1])._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("ArrowEvalPython") == 1


def test_runs_of_parts_of_a_batch(spark, lines, monkeypatch):
    """Texts are taken in parts of a batch, and rows without a key or a text have no runs."""
    found = []
    pairs = [(k, i, x, x.replace("the", "thc")) for k, text in lines[0] if text is not None for i, x in enumerate(text.split("\n"))]
    df = spark.createDataFrame([*pairs, (None, 0, "a", "b"), (999, 0, None, "b"), (999, 1, "a", None)], "k long, line int, old string, new string").coalesce(1)
    for size in (1 << 22, 300):
        monkeypatch.setattr(E, "BYTES_AT_ONCE", size)
        found.append(sorted(E.runs(df, ["k", "line"]).collect()))
    assert found[0] == found[1] and {r["k"] for r in found[0]} >= {63, 64, 65} and not {None, 999} & {r["k"] for r in found[0]}
    monkeypatch.setattr(E, "BYTES_AT_ONCE", 300)
    guarded = {r["k"]: (r["accepted"], r["rejected"], r["per_run"]) for r in E.guarded(df.filter("k is null or k = 63 or k = 999"), ["k", "line"]).collect()}
    assert guarded == {None: (0, 0, "a"), 63: (1, 0, "thc")}
