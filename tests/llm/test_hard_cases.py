"""Very long texts, rows that share a doc_id, missing ids, clashing columns, and plain twins of the methods."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from textloom.llm import anchor_dedup, decontam, fingerprint, langid, linededup, mixing, neardup, pii, quality, suffix_dedup
from textloom.llm.repeats import with_removals

CLASH = "doc_id long, text string, source string, lang string, kept string, gone string, row string, n_gone string, of string, gone_from string, n string, v string, at string, ws string, span string, part string, candidates string, base string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    """Columns that carry the operators' own names, rows without a doc_id, and rows that share one."""
    a, b = " ".join(f"alpha{k} beta{k}" for k in range(40)), " ".join(f"gamma{k} delta{k}" for k in range(40))
    rows = [(1, a), (1, a), (2, "short"), (2, a), (3, None), (None, a), (4, b), (5, b + " end"), (5, "short"), (6, ""), (None, None)]
    return spark.createDataFrame([(i, t, f"s{k % 3}", "en", *["x"] * 14) for k, (i, t) in enumerate(rows)], CLASH)


def test_rows_that_share_an_id(odd):
    near = rows_of(neardup.near_components(odd).select("doc_id", "component_id"))
    # 2 and 5 share the text "short", so both share the component of 1, and 5 is like 4
    assert near == sorted([(1, 1), (1, 1), (2, 1), (2, 1), (3, 3), (4, 1), (5, 1), (5, 1), (6, 6)])
    out = with_removals(odd, suffix_dedup.repeated_bytes(odd)).mapInArrow(suffix_dedup.removal_report, suffix_dedup.OUT).collect()
    gone = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in out)
    n = len(odd.first()["text"])
    assert [g for g in gone if g[0] == 1] == [(1, n, 0), (1, n, 0)]
    assert [g[2] for g in gone if g[0] == 2] == [5, n]  # both lose the places where one repeats document 1
    out = with_removals(odd, anchor_dedup.repeated_words(odd)).mapInArrow(anchor_dedup.removal_report, anchor_dedup.OUT).collect()
    assert sorted(r["n_removed"] for r in out if r["doc_id"] == 1) == [0, 0]
    assert sorted(r["n_removed"] for r in out if r["doc_id"] == 2) == [1, 80]
    assert len(out) == 9


def test_clashing_columns_and_missing_ids(spark, odd):
    bench = spark.createDataFrame([("i", "alpha1 beta1 alpha2 beta2 alpha3 beta3 alpha4 beta4 alpha5 beta5", "x")], "item_id string, text string, win string")
    hit = decontam.contamination(odd, bench).filter("contaminated").select("doc_id").collect()
    assert sorted(r[0] for r in hit) == [1, 1, 1, 1, 2, 2] or sorted({r[0] for r in hit}) == [1, 2]
    assert mixing.mixed(odd).count() == 9
    assert linededup.without_boilerplate(odd, 2).select("row.*").columns == odd.columns
    assert linededup.without_boilerplate(odd, 2).count() == odd.count()
    assert fingerprint.fingerprints(odd).count() == 9
    assert pii.found_spans(odd).count() == odd.count()
    assert quality.scored(quality.described(odd), quality.Discriminant({})).count() == odd.count()


def test_personal_data_in_long_texts(spark):
    texts = ["x a@b" + ".c" * 100_000 + " y", "1.2.3.4 " * 200_000, " ".join(f"ssn {k:09d}" for k in range(100_000)), " ".join("token=" + hashlib.sha1(b"%d" % k).hexdigest() for k in range(5000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r for r in pii.found_spans(df).collect()}
    assert [tuple(s) for s in found[0]["base"]] == [(0, 2, 5 + 200_000)]
    assert [(s["start"], s["end"]) for s in found[1]["base"]] == [(8 * k, 8 * k + 7) for k in range(200_000)]
    assert sum(s["k"] == 5 for s in found[2]["spans"]) == 100_000
    # a secret whose digits pass for a card is that
    assert sum(s["k"] == 4 for s in found[3]["spans"]) == 5000 - len({s["start"] // 47 for s in found[3]["base"]})


def test_added_spans_find_planted_ones(spark):
    rng = random.Random(3)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnr')}{rng.choice('aeiou')}" for _ in range(200)]
    rows, truth = [], {}
    for i in range(600):
        text, spans = " ".join(rng.choice(words) for _ in range(30)) + " ", set()
        if i % 3 == 0:
            text += rng.choice(("api_key = ", "password: ", "auth token="))
            secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
            spans.add(("secret", len(text), len(text) + 40))
            text += secret + " "
        if i % 4 == 0:
            text += "ssn: "
            spans.add(("id", len(text), len(text) + 11))
            text += f"{rng.randint(100, 999)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)} "
        if i % 5 == 0:
            text += f"see part{rng.randint(10**9, 10**10)}of{rng.choice(words)}/x2 and {rng.randint(100, 999)} {rng.randint(100, 999)} "
        rows.append((i, text))
        truth[i] = spans
    found = {r["doc_id"]: {(pii.KINDS[s["k"]], s["start"], s["end"]) for s in r["spans"] if s["k"] > 3} for r in pii.found_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    planted, got = sum(map(len, truth.values())), sum(map(len, found.values()))
    right = sum(len(truth[i] & found[i]) for i in truth)
    assert right >= 0.95 * planted and right >= 0.95 * got


def test_span_classifier_twin(spark):
    texts = [f"token={hashlib.sha1(b'%d' % k).hexdigest()} call 12 345 678 x{k}" for k in range(40)] + [f"see abc{k}defghijklmnopq/x ssn 123-45-{1000 + k}" for k in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.examined(df).collect()
    each = [(c["kind"], tuple(map(int, c["votes"].split(","))), c["features"]) for r in rows for c in r["candidates"]]
    odds = {}
    for kind in {k for k, *_ in each}:
        of = [(v, f) for k, v, f in each if k == kind]
        post, _ = pii.reliabilities(Counter(v for v, _ in of))
        yes, no = sum(post[v] for v, _ in of), sum(1 - post[v] for v, _ in of)
        odds[kind] = math.log((yes + 1) / (no + 1))
        for name in {x for _, f in of for x in f}:
            a, b = sum(post[v] for v, f in of if name in f), sum(1 - post[v] for v, f in of if name in f)
            odds[name] = math.log((a + 1) / (yes + 2)) - math.log((b + 1) / (no + 2))
    wanted = {(r["doc_id"], c["start"], c["end"]) for r in rows for c in r["candidates"] if odds[c["kind"]] + sum(odds[f] for f in c["features"]) > 0}
    found = {(r["doc_id"], s["start"], s["end"]) for r in pii.found_spans(df).collect() for s in r["spans"] if s["k"] > 3}
    assert found == wanted and wanted


def test_no_letter_is_no_language(spark):
    model = langid.train(spark.createDataFrame([(1, "en", "the house"), (2, "fr", "la maison")], "doc_id long, lang string, text string"))
    asked = ["½ ²", "①", "Ⅷ Ⅳ", "12 ½", "_", "٣", "the ½", "ª", "é"]
    found = langid.identify(spark.createDataFrame([(i, True, t) for i, t in enumerate(asked)], "doc_id long, held_out boolean, text string"), model)
    assert [r["lang_pred"] == "und" for r in sorted(found.collect())] == [True] * 6 + [False] * 3
    assert langid.words_of("Ab½c ①d_e") == ["ab", "c", "d", "e"]


def test_backoff_twin(spark):
    rng = random.Random(1)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n))
    train = [(i, lang, make(letters, 12)) for i, (lang, letters) in enumerate([("aa", "abcd"), ("bb", "cdef"), ("cc", "efgh")] * 10)]
    model = langid.train(spark.createDataFrame(train, "doc_id long, lang string, text string"))
    counts = {"w": {}, "g": {}}
    for _, lang, text in train:
        for w in text.split():
            counts["w"].setdefault(w, Counter())[lang] += 1
            marked = f"<{w}>"
            for size in range(1, 6):
                for k in range(len(marked) - size + 1):
                    counts["g"].setdefault(marked[k : k + size], Counter())[lang] += 1
    langs = ["aa", "bb", "cc"]
    total = {kind: {x: sum(c[x] for c in found.values()) for x in langs} for kind, found in counts.items()}

    def score(kind, item, lang):
        mean = sum(total[kind].values()) / 3
        return math.log((counts[kind][item][lang] * mean / total[kind][lang] + 0.5) / (mean + 0.5 * len(counts[kind])))

    def of(word, lang):
        if word in counts["w"]:
            return score("w", word, lang)
        marked = f"<{word}>"
        for size in range(5, 0, -1):
            known = [g for k in range(len(marked) - size + 1) if (g := marked[k : k + size]) in counts["g"]]
            if known:
                return sum(score("g", g, lang) for g in known) / len(known) + math.log(0.4) * (6 - size)
        return math.log(0.4) * 5

    asked = [make(rng.choice(("abcd", "cdef", "efgh", "abgh", "xyz")), 9) for _ in range(60)]
    found = sorted(langid.identify(spark.createDataFrame([(i, True, t) for i, t in enumerate(asked)], "doc_id long, held_out boolean, text string"), model).collect())
    for row, text in zip(found, asked, strict=True):
        totals = [sum(of(w, lang) for w in text.split()) for lang in langs]
        best = max(totals)
        assert totals[langs.index(row["lang_pred"])] == pytest.approx(best)
        assert row["score"] == pytest.approx(1 / sum(math.exp((t - best) / max(1.0, 9 / 20)) for t in totals))


def test_discriminant_twin():
    rng = np.random.default_rng(4)
    x = {0: rng.normal(0, 1, (80, 3)) @ rng.normal(0, 1, (3, 3)), 1: rng.normal(1, 2, (50, 3))}
    one = lambda m: np.hstack([np.ones((len(m), 1)), m])
    model = quality.Discriminant({c: one(m).T @ one(m) for c, m in x.items()})
    pooled = sum(len(m) * np.cov(m.T, bias=True) for m in x.values()) / 130
    asked, density = rng.normal(0, 2, (20, 3)), []
    for c, m in x.items():
        cov = 0.7 * np.cov(m.T, bias=True) + 0.3 * pooled
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov)) + quality.RIDGE * np.eye(3)
        d = asked - m.mean(0)
        density.append(np.log(len(m) / 130) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert model.score(asked) == pytest.approx(1 / (1 + np.exp(-(density[1] - density[0]) / quality.TEMPERATURE)))


def test_digest_twin():
    m32 = 0xFFFFFFFF

    def digest(raw):
        counts = [0] * 128
        for k, (a, b) in enumerate(fingerprint.GAPS):
            for i in range(len(raw) - b):
                h = (raw[i] * 0x01000193 + raw[i + a] * 0x85EBCA6B + raw[i + b] * 0xC2B2AE35 + k * 0x27D4EB2F) & m32
                h = ((h ^ h >> 15) * 0x2C1B3C6D) & m32
                counts[h >> 25] += 1
        ranked = sorted(counts)
        codes = [sum(c > ranked[q] for q in (31, 63, 95)) for c in counts]
        return codes, min(255, round(8 * math.log2(1 + len(raw))))

    texts = ["", "a", "abc", "abcd" * 30, "the quick brown fox " * 9, "é€" * 40, "".join(map(chr, range(32, 127)))]
    found = fingerprint.digests(*fingerprint.joined(texts))
    own = [digest(t.encode()) for t in texts]
    assert [list(c) for c in found[0]] == [c for c, _ in own] and list(found[1]) == [n for _, n in own]
    for (ca, na), (cb, nb), like in zip(own, own[1:], fingerprint.likeness(tuple(x[:-1] for x in found), tuple(x[1:] for x in found)), strict=False):
        diff = sum(abs(x - y) + 3 * (abs(x - y) == 3) for x, y in zip(ca, cb, strict=True)) + abs(na - nb) // 2
        assert like == pytest.approx(1 - min(260, diff) / 260)


def spark_hash(*values):
    """Spark's xxhash64 of ints (i32 as ("i", x)), longs and strings."""
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v[1].to_bytes(4, "little") if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
        h = xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >> 63 else h


def test_mixing_twin(spark):
    """The blocks that each slot takes, slot by slot."""
    rng = random.Random(9)
    docs = [(i, " ".join("w" for _ in range(rng.randint(0, 400))), f"s{i % 4}") for i in range(300)]
    found = {r["doc_id"]: r for r in mixing.mixed(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    seed = ("i", mixing.SEED)
    unit = lambda *of: spark_hash(seed, *of) % (1 << 52) / float(1 << 52)
    at, of_source = {}, {}
    for i, text, source in sorted(docs, key=lambda d: (spark_hash(d[0]) % mixing.BUCKETS, d[0])):
        at[i] = of_source.get(source, 0)
        of_source[source] = at[i] + len(text.split())
    names = sorted(of_source)
    blocks = {s: -(-of_source[s] // mixing.BLOCK) for s in names}
    target = {s: next(r["target"] for i, r in found.items() if docs[i][2] == s) for s in names}
    want = {s: target[s] / of_source[s] * blocks[s] for s in names}
    shards = int(-(-sum(want.values()) // mixing.SHARD))
    whole = {s: math.floor(want[s] / shards) for s in names}
    part = {s: want[s] / shards - whole[s] for s in names}
    left = sum(part.values())
    slots = {s: shards * whole[s] for s in names}
    for shard in range(shards):
        for k in range(1, int(left) + (unit(shard, "n") < left - int(left)) + 1):
            u, upto = unit(shard, ("i", k)) * left, 0.0
            for s in names:
                upto += part[s]
                if u < upto:
                    slots[s] += 1
                    break

    def permuted(i, n, *key):
        for turn in range(mixing.ROUNDS):
            mirror = (spark_hash(seed, ("i", turn), *key) % n - i) % n
            if spark_hash(max(i, mirror), ("i", turn), *key) % 2 == 0:
                i = mirror
        return i

    times = Counter((s, permuted(k % blocks[s], blocks[s], k // blocks[s], s)) for s in names for k in range(min(slots[s], mixing.CAP * blocks[s])))
    for i, text, source in docs:
        n = len(text.split())
        wanted = sum(times[source, w // mixing.BLOCK] for w in range(at[i], at[i] + n))
        assert found[i]["taken"] == wanted


def test_many_lines_in_one_document(spark):
    line = lambda d, k: "the shared line" if k % 2 else f"{d} line {k}"
    docs = spark.createDataFrame([(d, "\n".join(line(d, k) for k in range(40_000)), f"s{d}") for d in range(12)], "doc_id long, text string, source string").repartition(4)
    out = {r["row"]["doc_id"]: (len(r["kept"]), r["n_gone"]) for r in linededup.without_boilerplate(docs).collect()}
    assert out == {d: (20_001, 19_999) if d == 0 else (20_000, 20_000) for d in range(12)}


def test_one_phrase_shared_by_all_items(spark, monkeypatch):
    phrase = "answer the question with yes or no and say why you think so please"
    items = [(k, f"{phrase} {' '.join(f'item{k}word{j}' for j in range(12))}") for k in range(300)]
    docs = [(1, f"they said {phrase} again"), (2, "nothing of the kind"), (3, items[7][1])]
    args = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    usual = rows_of(decontam.contamination(*args))
    assert [(r[0], r[3]) for r in usual] == [(1, 300), (2, 0), (3, 300)]
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 1000)
    assert rows_of(decontam.contamination(*args)) == usual


def test_one_passage_in_many_documents(spark):
    """A passage in differing surroundings crowds the anchors at its ends."""
    rng = random.Random(2)
    passage = " ".join(f"p{k}" for k in range(60))
    mine = lambda i, side: " ".join(f"{side}{i}x{rng.randrange(10**6)}" for _ in range(12))
    docs = [(i, f"{mine(i, 'l')} {passage} {mine(i, 'r')}") for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    seen, wanted = set(), {}
    for i, t in docs:
        raw = t.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(raw[s : s + 100])
        wanted[i] = sum(gone)
    out = with_removals(df, suffix_dedup.repeated_bytes(df)).mapInArrow(suffix_dedup.removal_report, suffix_dedup.OUT).collect()
    assert {r["doc_id"]: r["n_removed"] for r in out} == wanted


@pytest.mark.parametrize("text", ["a" * 1_000_000, "é²" * 300_000, "x#" * 500_000, "ab cd " * 170_000, "\n" * 1_000_000])
def test_texts_of_a_megabyte(spark, text):
    """Each takes time in proportion to its length; a quadratic step would take hours."""
    assert len(quality.statistics(text)) == len(quality.NAMES)
    assert len(langid.words_of(text)) <= len(text)
    docs = spark.createDataFrame([(1, text), (2, "short text")], "doc_id long, text string")
    assert fingerprint.fingerprints(docs).count() == 2
    assert neardup.near_components(docs).count() == 2


def test_words_with_marks_inside():
    import re

    at = quality.NAMES.index("words_with_marks_inside")
    for text in ("", "a", "a#b c", "## a-b 'c' é…", "x  y\u00a0z* \x1c!", "no (marks) [here]?"):
        words = text.split()
        share = sum(bool(re.search(r"[^\w\s.,;:'\"-]", w)) for w in words) / max(1, len(words))
        assert quality.statistics(text)[at] == pytest.approx(math.asin(math.sqrt(share)))


def test_staging_needs_a_shared_folder():
    from types import SimpleNamespace

    from textloom.llm.common import shared_dir

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(cluster)
