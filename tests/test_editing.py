"""Edits as rows against brute force on random pairs, and their rules on literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import editing as E

EDITS = "array<struct<before:string,after:string>>"


def words_of(rng, n):
    return [rng.choice(["the", "cat", "sat", "on", "mat", "a", "bird", "", "löw", "rnan"]) for _ in range(n)]


def changed(rng, words):
    out = list(words)
    for _ in range(rng.randint(0, 3)):
        k = rng.randrange(len(out) + 1)
        out[k : k + rng.randint(0, 2)] = words_of(rng, rng.randint(0, 2))
    return out


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(4)
    found = []
    for k in range(400):
        words = words_of(rng, rng.randint(1, 12))
        found.append((k, " ".join(words), " ".join(changed(rng, words))))
    long = [str(n) for n in range(3000)]
    found += [(400, " ".join(long), " ".join([*long[:1500], "new", *long[1501:]])), (401, "", ""), (402, "x", ""), (403, None, "x"), (404, "same", "same")]
    return found


@pytest.fixture(scope="module")
def frame(spark, pairs):
    return spark.createDataFrame(pairs, "k long, old string, new string").repartition(3)


def brute_runs(old, new):
    a, b = old.split(" "), new.split(" ")
    nth = lambda ws: {(w, ws[:i].count(w)): i for i, w in enumerate(ws)}
    x, y = nth(a), nth(b)
    met = sorted((x[w], y[w]) for w in x.keys() & y.keys())
    fixed = [p for p in met if all((p[0] - q[0]) * (p[1] - q[1]) > 0 for q in met if q != p)]
    out, i, j = [], 0, 0
    for p, q in [*fixed, (len(a), len(b))]:
        if (i, j) != (p, q):
            out.append((i, p, j, q))
        i, j = p + 1, q + 1
    return out


def test_runs(frame, pairs):
    found = {}
    for r in E.runs(frame, ["k"]).collect():
        found.setdefault(r["k"], []).append((r["i0"], r["i1"], r["j0"], r["j1"]))
    for k, old, new in pairs:
        if old is not None and len(old) < 5000:
            assert sorted(found.get(k, [])) == brute_runs(old, new), (old, new)
    assert found[400] == [(1500, 1501, 1500, 1501)]


def apply_to(text, edits):
    """Brute force of the rules: (text, applied, rejected) of edits that stand once, apart, within the budget."""
    claims, rejected = [], []
    for before, after in edits:
        places = [i for i in range(len(text)) if text.startswith(before, i)] if before else []
        why = "empty" if not before else "long" if len(before) > 80 else "missing" if not places else "ambiguous" if len(places) > 1 else None
        if why:
            rejected.append(why)
        else:
            claims.append((places[0], before, after))
    kept, end = [], -1
    for c in sorted(claims):
        if c[0] >= end:
            kept.append(c)
            end = c[0] + len(c[1])
        else:
            rejected.append("overlap")
    touched = sum(max(len(b), len(a)) for _, b, a in kept)
    if touched > 12 and touched > len(text) * 0.25:
        return text, 0, sorted(rejected + ["budget"] * len(kept))
    out = text
    for at, before, after in reversed(kept):
        out = out[:at] + after + out[at + len(before) :]
    return out, len(kept), sorted(rejected)


def test_derived_edits_carry_old_into_new(frame, pairs):
    found = {r["k"]: r["edits"] for r in E.derived(frame, ["k"]).collect()}
    assert found.keys() == {k for k, *_ in pairs}
    safe = 0
    for k, old, new in pairs:
        edits = found[k]
        if old == new and old is not None:
            assert edits == []
        elif edits is not None:
            safe += 1
            assert apply_to(old, [(e["before"], e["after"]) for e in edits]) == (new, len(edits), [])
    assert found[403] is None and safe > 60
    assert [tuple(e) for e in found[400]] == [("1500", "new")]


@pytest.mark.parametrize(
    ("old", "new", "edits"),
    [("a bad wcrd here", "a bad word here", [("wcrd", "word")]), ("put it on", "put it on top", [("on", "on top")]), ("tbe rnan sat", "the man sat", [("tbe rnan", "the man")]), ("a line\nb", "a line\nc", None), ("all of this was", "none is like it", None)],
)
def test_derived_cases(spark, old, new, edits):
    row = E.derived(spark.createDataFrame([(1, old, new)], "k long, old string, new string"), ["k"]).first()
    assert (row["edits"] and [tuple(e) for e in row["edits"]]) == edits


def test_applied(spark):
    rng = random.Random(6)
    text = "the cat and the dog and so on and on"
    rows = [(0, text, [("", "x"), ("bird", "x"), ("the ", "a "), ("x" * 81, "y"), ("cat and", "c"), ("and the d", "d")]), (1, text, [("the cat and the dog and so", "all of it")]), (2, "aaa", [("aa", "b")]), (3, None, None), (4, "abc", None)]
    for k in range(5, 200):
        t = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60)))
        cut = lambda: t[(i := rng.randrange(len(t) + 1)) : i + rng.randint(0, 9)]  # noqa: E731, B023
        rows.append((k, t, [(cut(), "".join(rng.choice("xy") for _ in range(rng.randint(0, 4)))) for _ in range(rng.randint(0, 4))]))
    done = E.applied(spark.createDataFrame(rows, f"k long, t string, e {EDITS}"), "t", "e").collect()
    for r in done:
        want = apply_to(r["t"] or "", [tuple(e) for e in r["e"] or []])
        assert (r["done"]["text"], r["done"]["applied"], sorted(r["done"]["rejected"])) == want
    assert {s for r in done for s in r["done"]["rejected"]} == {"empty", "missing", "ambiguous", "long", "overlap", "budget"}


def test_plausible(spark):
    rows = [(["onthe"], ["on", "the"], True), (["a"], ["a", "b"], False), (["it’s"], ["it's"], False), (["word"], ["sentence"], False), (["tbe", "rnan"], ["the", "man"], True), (["-"], ["-", ""], False), ([], ["x"], False)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, want boolean")
    assert all(r["want"] == r["found"] for r in df.withColumn("found", E.plausible(F.col("a"), F.col("b"))).collect())


def test_guarded(spark):
    rows = [(1, "tbe cat sat onthe mat", "the cat sat on the tiger"), (2, "same", "same"), (3, None, "x"), (4, "a b", "a c")]
    found = {r["k"]: (r["accepted"], r["rejected"], r["per_run"]) for r in E.guarded(spark.createDataFrame(rows, "k long, old string, new string"), ["k"]).collect()}
    assert found == {1: (1, 1, "the cat sat onthe mat"), 2: (0, 0, "same"), 4: (1, 0, "a c")}


def test_words_stay_where_their_pair_is_dealt(spark):
    """Texts are exchanged by their keys, never words: no exchange stands above a posexplode, but for broadcasts."""
    pairs = spark.range(100).selectExpr("id", "concat('a b ', id, ' c') AS old", "concat('a x ', id, ' c d') AS new")
    plan = E.derived(pairs, ["id"])._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert exchanges and all("REPARTITION_BY_NUM" in line for line in exchanges)
