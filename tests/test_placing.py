"""Blocks placed in a stream against a brute-force version that holds both texts."""

import random
from bisect import bisect_left
from collections import Counter, defaultdict

import pytest

from textloom.operators import placing as P


def chain(values):
    ends, tails, parent = [], [], {}
    for o, v in values:
        p = bisect_left(ends, v)
        parent[o] = tails[p - 1] if p else None
        ends[p : p + 1], tails[p : p + 1] = [v], [o]
    out, at = set(), tails[-1] if tails else None
    while at is not None:
        out.add(at)
        at = parent[at]
    return out


def share(words, stream, start, end):
    at, hit = max(0, start), 0
    for w in words:
        for j in range(at, min(end, len(stream))):
            if stream[j] == w:
                hit, at = hit + 1, j + 1
                break
    return hit / len(words) if words else 0.0


def brute(blocks, stream):
    index = defaultdict(list)
    for i in range(len(stream) - 3):
        index[tuple(stream[i : i + 4])].append(i)
    est = {}
    for b, words in blocks.items():
        votes = Counter(p - i for i in range(len(words) - 3) for p in index[tuple(words[i : i + 4])] if len(index[tuple(words[i : i + 4])]) <= 2)
        if votes:
            place, n = min(votes.items(), key=lambda x: (-x[1], x[0]))
            if n >= (2 if len(words) >= 12 else 1):
                est[b] = place
    flow = chain(sorted(est.items()))
    out = {}
    for b, e in est.items():
        ratio = share(blocks[b], stream, e - 3, e + len(blocks[b]) + 5)
        if ratio >= (0.55 if b in flow else 0.7):
            out[b] = (e, ratio, b in flow)
    matched = dict(out)
    for b, words in blocks.items():
        on = {k: v for k, v in matched.items() if v[2]}
        prev = max((k for k in on if k < b), default=None)
        nxt = min((k for k in on if k > b), default=None)
        if b in matched or not words or (prev is None and nxt is None):
            continue
        first = on[prev][0] + len(blocks[prev]) if prev is not None else None
        last = on[nxt][0] if nxt is not None else None
        lo = max(0, (first if first is not None else last - 600) - 40)
        hi = min(len(stream), (last if last is not None else first + 600) + 40)
        tries = [(share(words, stream, p, p + len(words) + 5), -p) for p in range(lo, hi - len(words) + 1, max(1, len(words) // 2))]
        if tries and max(tries)[0] >= 0.6:
            out[b] = (-max(tries)[1], max(tries)[0], None)
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(150)]
    out = {}
    for key in range(6):
        stream = [rng.choice(vocabulary) for _ in range(rng.choice([0, 30, 800]))]
        blocks, at = {}, 0
        while at < len(stream):
            n = rng.randint(1, 25)
            words = [w if rng.random() < 0.85 else "x" for w in stream[at : at + n]]
            blocks[len(blocks)] = words if rng.random() < 0.9 else [rng.choice(vocabulary) for _ in range(n)]
            at += n
        keys = list(blocks)
        for _ in range(len(blocks) // 8):  # some blocks stand elsewhere
            a, b = rng.sample(keys, 2)
            blocks[a], blocks[b] = blocks[b], blocks[a]
        blocks[len(blocks)] = []
        out[key] = (blocks, stream)
    return out


def test_placed_blocks(spark, texts):
    b = spark.createDataFrame([(k, n, w) for k, (blocks, _) in texts.items() for n, w in blocks.items()], "key int, block int, words array<string>")
    s = spark.createDataFrame([(k, i, w) for k, (_, stream) in texts.items() for i, w in enumerate(stream)], "key int, pos int, word string")
    found = defaultdict(dict)
    for r in P.placed_blocks(b, s, "key").collect():
        found[r["key"]][r["block"]] = (r["pos"], pytest.approx(r["ratio"]), r["flow"])
    total = 0
    for k, (blocks, stream) in texts.items():
        want = brute(blocks, stream)
        assert found[k] == want
        total += len(want)
    assert total > 100


def test_rising_chain(spark):
    rng = random.Random(12)
    rows = [(g, o, rng.randrange(30)) for g in range(20) for o in range(rng.randint(0, 40))] + [(99, o, (o * 7919) % 10_007) for o in range(10_000)]
    found = defaultdict(set)
    for g, o in P.rising_chain(spark.createDataFrame(rows, "g int, o int, v int").repartition(5), "g", "o", "v").collect():
        found[g].add(o)
    values = defaultdict(list)
    for g, o, v in rows:
        values[g].append((o, v))
    assert found == {g: chain(sorted(v)) for g, v in values.items()}
