"""The corpus operators against brute force, on a small corpus of hard cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from textloom.llm import decontam, fingerprint, langid, linededup, mixing, neardup, pii, quality
from textloom.llm.anchor_dedup import removal_report as report_words
from textloom.llm.anchor_dedup import repeated_words
from textloom.llm.repeats import with_removals
from textloom.llm.suffix_dedup import removal_report as report_bytes
from textloom.llm.suffix_dedup import repeated_bytes
from textloom.llm.anchor_dedup import OUT as WORDS_OUT
from textloom.llm.suffix_dedup import OUT as BYTES_OUT

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, h long, marks int, kept boolean, label int, bucket string"


def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoé") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, passage = make(120), make(40)
    texts = [None, "", "   \n\t ", "one", "One TWO three", " ".join(base), " ".join(base), " ".join(base).upper()]
    for k in range(12):  # near copies, each with a few words of its own
        words = list(base)
        for _ in range(k // 2):
            words[rng.randrange(len(words))] = f"x{k}"
        texts.append(" ".join(words))
    for _ in range(12):  # one passage in different surroundings
        texts.append(" ".join(make(30) + passage + make(25)))
    texts += ["a " * 3000, "ab" * 4000, " ".join(make(4000)), "the same line\nother " + " ".join(make(8)), "mail a.b@c.de 4111 1111 1111 1111 10.0.0.1 +1 (212) 555-0100 x"]
    texts += [f"boilerplate line here\n{' '.join(make(9))}" for _ in range(14)]
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "s0", "s0"][i % 3] if i < 20 else f"s{i}", 0, "x", 1, 2, True, 3, "b") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(rows):
    return sorted((r[0], r[1] or "") for r in rows)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_repeated_bytes(docs, none, rows):
    seen, wanted = set(), {}
    for i, t in texts_of(rows):
        raw = t.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(raw[s : s + 100])
        left = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        wanted[i] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest())
    report = lambda d: with_removals(d, repeated_bytes(d)).mapInArrow(report_bytes, BYTES_OUT)
    assert by_id(report(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == wanted
    assert report(none).count() == 0


@pytest.mark.parametrize("many", [1, 2, 5])
def test_crowded_anchors_are_split(docs, monkeypatch, many):
    from textloom.llm import suffix_dedup

    usual = by_id(with_removals(docs, repeated_bytes(docs)).mapInArrow(report_bytes, BYTES_OUT), "n_removed", "kept_sha256")
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    assert by_id(with_removals(docs, repeated_bytes(docs)).mapInArrow(report_bytes, BYTES_OUT), "n_removed", "kept_sha256") == usual


def test_repeated_words(docs, none, rows):
    seen, wanted = set(), {}
    for i, t in texts_of(rows):
        words = t.encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            window = tuple(words[s : s + 20])
            if window in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(window)
        wanted[i] = (len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).hexdigest())
    report = lambda d: with_removals(d, repeated_words(d)).mapInArrow(report_words, WORDS_OUT)
    assert by_id(report(docs), "n_words", "n_removed", "kept_sha256") == wanted
    assert report(none).count() == 0


def components(rows, size, percent):
    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    sets, parent, lists = {}, {}, defaultdict(list)
    for i, t in texts_of(rows):
        w = t.encode().translate(lower).split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        met = Counter()
        for s in sets[i]:
            met.update(lists[s])
            lists[s].append(i)
        for j, n in met.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("size", [4, 5])
def test_near_components(docs, none, rows, size):
    assert by_id(neardup.near_components(docs, size), "n_shingles", "component_id") == components(rows, size, 80)
    if size == 4:
        assert neardup.near_components(none).count() == 0


def test_fingerprints(docs, none, rows):
    found = by_id(fingerprint.fingerprints(docs), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    order = texts_of(rows)
    prints = defaultdict(set)
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert found[i][0] == len(t)
        assert found[i][1] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= found[i][4] <= 1 and 0 <= found[i][5] <= 1
        prints[t].add(found[i][2])
        if edited == t:
            assert found[i][4] == 1 and found[i][2] == found[i][3]
    assert all(len(p) == 1 for p in prints.values())
    assert fingerprint.fingerprints(none).count() == 0


def test_contamination(spark, docs, none, rows):
    base = dict(texts_of(rows))
    item = " ".join(base[5].split()[10:24])
    items = [(1, item), (1, item), (2, base[5].split()[3]), (3, ""), (None, "x"), (4, None), (5, "a b c d e f g h i j k l m"), (6, "One two")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: pattern.findall((t or "").translate(lower))
    windows = set()
    for i, t in items:
        w = words(t)
        if i is not None and w:
            n = min(10, len(w))
            windows |= {(i, tuple(w[k : k + n])) for k in range(len(w) - n + 1)}
    wanted = {}
    for i, t in base.items():
        w, hit, met = words(t), set(), set()
        for item_id, win in windows:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    met.add(str(item_id))
        wanted[i] = (len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit))
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert by_id(decontam.contamination(docs, benchmark), *columns) == wanted
    assert decontam.contamination(none, benchmark).count() == 0
    assert not any(r["contaminated"] for r in decontam.contamination(docs, benchmark.limit(0)).collect())


def test_contamination_of_repeated_words(spark):
    """Grams that recur inside a window: each window is compared, however long one least hash lasts."""
    texts = ["la " * 50, "ha ho hi " * 40, "one one one", "One, one two one ONE", "la " * 7 + "end of this", "la " * 30 + "end of this " + "la " * 9, "a b a b a b a b a b a b c d", "x " + "ab cd " * 20 + "y"]
    items = [(1, "la " * 10), (2, "ha ho hi " * 4), (3, "one"), (4, "la " * 7 + "end of this"), (5, "b a b a b a b a b c"), (6, "la la"), (7, "cd ab cd"), (8, "ab cd " * 5 + "y")]
    windows = set()
    for i, t in items:
        w = t.lower().split()
        n = min(10, len(w))
        windows |= {(i, tuple(w[k : k + n])) for k in range(len(w) - n + 1)}
    wanted = {}
    for i, t in enumerate(texts):
        w, hit, met = t.replace(",", "").lower().split(), set(), set()
        for item_id, win in windows:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    met.add(str(item_id))
        wanted[i] = (len(w), len(hit), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest())
    found = decontam.contamination(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert by_id(found, "n_words", "n_hit", "items_sha256") == wanted


def test_contamination_without_broadcast(spark, docs, monkeypatch):
    benchmark = spark.createDataFrame([(1, "boilerplate line here"), (2, "the same line other")], "item_id long, text string")
    usual = by_id(decontam.contamination(docs, benchmark), "n_hit", "items_sha256")
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert by_id(decontam.contamination(docs, benchmark), "n_hit", "items_sha256") == usual
    assert sum(n for n, _ in usual.values()) > 0


def test_mixing(docs, none, rows):
    found = {r["doc_id"]: r for r in mixing.mixed(docs).collect()}
    size = {i: len(t.encode().split()) for i, t in texts_of(rows)}
    source = {r[0]: r[3] for r in rows}
    sizes = Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, rest, open_ = {}, float(sum(sizes.values())), set(order)
    while True:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    taken = Counter()
    for i, r in found.items():
        assert r["size"] == size[i] and r["source_size"] == sizes[source[i]]
        assert r["target"] == pytest.approx(target[source[i]], rel=1e-9)
        assert 0 <= r["taken"] <= 3 * size[i]
        taken[source[i]] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= max(4 * mixing.BLOCK, 0.1 * target[s])
    assert {i: r["taken"] for i, r in found.items()} == by_id_one(mixing.mixed(docs), "taken")
    assert mixing.mixed(none).count() == 0


def by_id_one(df, column):
    return {r["doc_id"]: r[column] for r in df.collect()}


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 64, 1000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3)).alias("p"))
        assert sorted(r[0] for r in df.collect()) == list(range(n))


def test_line_dedup(docs, none, rows):
    spread, order = defaultdict(set), []
    for i, t, _, source, *_ in sorted(rows):
        for k, line in enumerate((t if t is not None else None).split("\n") if t is not None else []):
            order.append((i, k, line))
            if line.strip(" \t\r\x0b\x0c") and source is not None:
                spread[line].add(source)
    bad = {x for x, s in spread.items() if len(s) >= linededup.SITES}
    seen, kept = set(), defaultdict(list)
    for i, _, line in order:
        if line not in bad or line not in seen:
            kept[i].append(line)
        seen.add(line)
    assert bad
    found = {r["row"]["doc_id"]: r["kept"] for r in linededup.without_boilerplate(docs).collect()}
    for i, t, *_ in rows:
        assert (found[i] or []) == kept[i]
        assert (found[i] is None) == (t is None)
    assert linededup.without_boilerplate(none).count() == 0


def base_spans(t):
    def luhn(d):
        total = 0
        for k, c in enumerate(reversed(d)):
            x = int(c) * (1 + k % 2)
            total += x - 9 if x > 9 else x
        return total % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return out


HARD = [
    "a@b.c_x@d.e.f", "é€ a@b.co, x@y", "@a.b c@d.", "..@-.-", "1.2.3.4.5.6.7.8", "999.1.1.1 01.002.3.4", "4111-1111 11111111 ", "4111  1111", "+12345678 +1 (23).45-6789", "++1 22 333 4444",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "123456789012345678901", "a" * 5000 + "@b.c", "1 " * 3000, "a@b.c" * 50, "",
]


def test_personal_data(spark, docs, none, rows):
    hard = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    for df, texts in ((hard, dict(enumerate(HARD))), (docs, dict(texts_of(rows)))):
        found = {r["doc_id"]: r for r in pii.found_spans(df).collect()}
        for i, t in texts.items():
            base = [(pii.KINDS[s["k"]], s["start"], s["end"]) for s in found[i]["base"]]
            assert base == base_spans(t), t[:80]
            all_ = [(pii.KINDS[s["k"]], s["start"], s["end"]) for s in found[i]["spans"]]
            assert set(base) <= set(all_)
    assert pii.found_spans(none).count() == 0


def test_a_labeler_that_errs_is_trusted_less():
    counts = {(1, 1, 1): 50, (0, -1, 0): 50, (1, -1, 0): 30, (-1, 1, 1): 10}
    post, right = pii.reliabilities(counts)
    assert post[1, 1, 1] > 0.9 and post[0, -1, 0] < 0.1
    assert right[0] < right[2]


def test_language(spark, docs, none):
    train = [(i, lang, " ".join([word, f"{word}s"] * 5)) for i, (lang, word) in enumerate([("en", "the"), ("fr", "les"), ("en", "house"), ("fr", "maison")] * 3)]
    model = langid.train(spark.createDataFrame(train, "doc_id long, lang string, text string"))
    asked = [(1, True, "the house"), (2, True, "maisonette"), (3, True, None), (4, True, "12 !"), (5, True, "")]
    found = by_id(langid.identify(spark.createDataFrame(asked, "doc_id long, held_out boolean, text string"), model), "lang_pred", "score")
    assert [found[i][0] for i in range(1, 6)] == ["en", "fr", "und", "und", "und"]
    nothing = langid.train(none.select("doc_id", "lang", "text"))
    assert {r["lang_pred"] for r in langid.identify(spark.createDataFrame(asked, "doc_id long, held_out boolean, text string"), nothing).collect()} == {"und"}


def test_small_languages_are_learned(spark):
    """A language of few rows trains on all of them beside a hot one, and what no language has seen favours none."""
    rows = [(i, "en", f"the house of number {'abcdefghij'[i % 10]}") for i in range(3000)] + [(5000 + i, "eu", "etxea handia da") for i in range(3)] + [(6000 + i, "fr", "la maison") for i in range(40)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3), 150)
    assert model.langs == ["en", "eu", "fr"]
    asked = [(1, True, "etxea"), (2, True, "the house"), (3, True, "maison")]
    found = by_id(langid.identify(spark.createDataFrame(asked, "doc_id long, held_out boolean, text string"), model), "lang_pred")
    assert [found[i][0] for i in range(1, 4)] == ["eu", "en", "fr"]
    en, eu, fr = model.table[model.words["etxea"]]
    assert en == fr < eu
    en, eu, fr = model.table[model.words["house"]]
    assert eu == fr < en


def test_the_whole_vocabulary_is_kept(spark):
    many = ["".join("abcdefghij"[int(d)] for d in str(k)) for k in range(100_000, 161_000)]
    rows = [(1, "en", " ".join(many * 2)), (2, "fr", "xylophone " + " ".join(many[:5])), (3, "de", "xylophone zwei drei")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert model.langs == ["de", "en", "fr"] and set(model.words) == {*many, "xylophone", "zwei", "drei"}
    de, en, fr = model.table[model.words["xylophone"]]
    assert en < fr < de
    de, en, fr = model.table[model.words[many[0]]]
    assert de < en < fr


def test_language_of_held_out_documents(spark):
    from pyspark.sql import functions as F

    out = langid.op7_word_first_backoff(spark, "/root/testdata/sf0.001")
    truth = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang")
    held = out.filter("held_out").join(truth, "doc_id")
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.9


def test_quality_of_held_out_documents(spark):
    from pyspark.sql import functions as F

    out = quality.op5_quadratic_discriminant(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    held = out.filter("held_out").join(labels, "doc_id")
    assert held.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] >= 0.95


def test_quality_edge_cases(spark, docs, none):
    labels = spark.createDataFrame([(5, 1), (6, 1), (20, 0), (21, 0), (22, 1), (99, 7), (23, None)], "doc_id long, label int")
    stats = quality.described(docs)
    for model in (quality.fit(stats, labels), quality.fit(stats, labels.filter("label = 1"))):
        scores = [r["score"] for r in quality.scored(stats, model).collect()]
        assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    assert quality.scored(quality.described(none), model).count() == 0
