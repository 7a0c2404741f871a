"""Fits and clusterings of all groups at once against a loop over the groups."""

import random

import numpy as np
import pytest

from textloom.operators import fitting as G


def lloyd(ids, v):
    order = np.argsort(ids)
    v = v[order]
    c0 = v[0]
    far = ((v - c0) ** 2).sum(1)
    c1 = v[int(far.argmax())]
    for _ in range(G.ROUNDS):
        part = ((v - c1) ** 2).sum(1) < ((v - c0) ** 2).sum(1)
        new = (v[~part].mean(0) if (~part).any() else c0, v[part].mean(0) if part.any() else c1)
        if np.allclose(new[0], c0, atol=1e-12) and np.allclose(new[1], c1, atol=1e-12):
            break
        c0, c1 = new
    n1 = int(part.sum())
    if n1 in (0, len(v)):
        return 1.0, 0.0
    return float(c0 @ c1 / np.linalg.norm(c0) / np.linalg.norm(c1)), min(n1, len(v) - n1) / len(v)


def test_mix_scores(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for g in range(12):
        n = [3, 4, 9, 40][g % 4]
        v = rng.normal(size=(n, 6)) + (g % 3) * np.outer(np.arange(n) % 2, rng.normal(size=6))
        if g == 11:
            v = np.ones((n, 6))
        ids = rng.permutation(1000)[:n]
        rows += [(g, int(i), x.tolist()) for i, x in zip(ids, v, strict=True)]
        want[g] = lloyd(ids, v) if n >= 4 else (1.0, 0.0)
    out = {r["g"]: (r["score"], r["share"]) for r in G.mix_scores(spark.createDataFrame(rows, "g int, i long, v array<double>"), "g", "i", "v").collect()}
    assert out.keys() == want.keys()
    for g in want:
        assert out[g] == pytest.approx(want[g], abs=1e-9)


def plain_linkage(x, cut):
    d = 1 - x @ x.T
    clusters = [[i] for i in range(len(x))]
    while len(clusters) > 1:
        best = min((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j)
        if best[0] > cut:
            break
        clusters[best[1]] += clusters.pop(best[2])
    out = np.zeros(len(x), int)
    for c in clusters:
        out[c] = min(c)
    return out


@pytest.mark.parametrize("cut", [0.2, 0.6, 1.0])
def test_linkage_is_plain_agglomeration(cut):
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 60):
        x = rng.normal(size=(n, 4))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        labels = G.linkage(x, cut)
        least = np.array([np.flatnonzero(labels == k)[0] for k in labels])
        assert least.tolist() == plain_linkage(x, cut).tolist()


def test_blocks(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 8))
    rows = [(k % 2, k, (centres[k % 5] + rng.normal(size=8) * 0.05).tolist()) for k in range(500)]
    out = {r["id"]: r["cluster"] for r in G.average_linkage(spark.createDataFrame(rows, "b int, i long, v array<double>"), "b", "i", "v", 0.2).collect()}
    assert out == {k: k % 10 for k in range(500)}


def brute_fit(lines, bands):
    best = None
    for start, b0 in enumerate(G.STARTS):
        a, b = 1.0, b0
        for _ in range(G.FIT_ROUNDS):
            pairs = [(r, min(bands, key=lambda c: (abs(c - (a * r + b)), c))) for r in lines]  # noqa: B023
            pairs = [(r, c) for r, c in pairs if abs(c - (a * r + b)) <= G.REACH]
            if len(pairs) < G.LEAST_PAIRS:
                break
            r, c = np.array(pairs).T
            rr = ((r - r.mean()) ** 2).sum()
            a2 = min(G.SCALES[1], max(G.SCALES[0], ((r - r.mean()) * (c - c.mean())).sum() / rr)) if rr > 1e-6 else a
            b2 = c.mean() - a2 * r.mean()
            done = abs(a2 - a) < 1e-6 and abs(b2 - b) < 0.05
            a, b = a2, b2
            if done:
                break
        hits = [h for h in (min(abs(c - (a * r + b)) for c in bands) for r in lines) if h <= G.HIT]
        back = sum(min(abs(c - (a * r + b)) for r in lines) <= G.HIT for c in bands)
        key = (-(len(hits) + back), float(np.median(hits)) if hits else 99.0, start)
        if best is None or key < best[0]:
            best = (key, a, b)
    return best[1], best[2], -best[0][0]


def test_fits(spark):
    rng = random.Random(5)
    pages = {}
    for p in range(25):
        lines = sorted(rng.uniform(0, 700) for _ in range(rng.randint(3, 30)))
        a, b = 1 + rng.uniform(-0.03, 0.03), rng.uniform(-18, 18)
        bands = [a * r + b + rng.uniform(-1, 1) for r in lines if rng.random() < 0.9] + [rng.uniform(0, 700) for _ in range(2)]
        pages[p] = (lines, bands, a, b)
    frame = lambda k, name: spark.createDataFrame([(p, float(x)) for p, v in pages.items() for x in v[k]], f"page int, {name} double")
    out = {r["page"]: (r["a"], r["b"], r["votes"]) for r in G.nearest_fits(frame(0, "r"), frame(1, "c"), "page").collect()}
    near = 0
    for p, (lines, bands, a, b) in pages.items():
        if len(bands) >= 3:
            want = brute_fit(lines, bands)
            assert out[p][2] == want[2] and out[p][:2] == pytest.approx(want[:2], abs=1e-6)
            near += len(lines) >= 8 and abs(out[p][0] * 350 + out[p][1] - (a * 350 + b)) < 2
    assert near >= 12  # the planted shift is found where there are lines enough


def jobs_of(spark, work):
    """What work returns, and how many jobs Spark ran for it."""
    spark.sparkContext.setJobGroup("counted", "")
    out = work()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    spark.sparkContext._jsc.clearJobGroup()
    return out, jobs


def test_pages_are_fitted_where_they_are_read_or_in_rounds(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(p, rng.choice([round(rng.uniform(0, 90), 1), 50.0])) for p in range(40) for _ in range(2 + 3 * p % 70)]
    rows += [(p, x) for p in (3, 50, 51) for x in (None, float("nan"), float("inf"), float("-inf"), 4.0)] + [(None, 5.0)] * 9
    lines = spark.createDataFrame(rows, "page string, r double")
    bands = lines.filter("r is null or r <> 50 or page % 3 = 0").selectExpr("page", "r * 1.01 + 3 as c")
    frame = lambda: sorted((r["page"], round(r["a"], 6), round(r["b"], 6), r["votes"], round(r["residual"], 6)) for r in G.nearest_fits(lines, bands, "page").collect())
    found, jobs = jobs_of(spark, frame)
    assert jobs < 15  # no rounds over tables
    monkeypatch.setattr(G, "AT_ONCE", 7)
    assert frame() == found
    monkeypatch.setattr(G, "MOST_ON_PAGE", 60)
    assert frame() == found
    assert {"50", "51"} <= {r[0] for r in found} and all(r[0] is not None for r in found)
