"""Language identification by word-first backoff.

Known words are scored by their log frequency in each language. A word that training has not seen is scored by
its longest known character n-grams, from five letters down to one, each step back at a fixed cost. A text's
language is the one of the highest total.

The model is fitted on a sample of about SAMPLE_ROWS labelled rows, picked by a hash of doc_id, and keeps every word
and n-gram of it with its counts in all languages: the sample bounds what is broadcast. Languages share the sample
evenly; those of fewer rows than their share train on all of them, and none gets under LEAST_ROWS of its rows. Each
language's counts are scaled to one total, and half a count is added for every item of the vocabulary of all
languages, so what a language has not seen costs the same in each, however small it is. Scores read whole texts of
all rows.

Defined cases: a null text or one without a letter is `und` with score 0; rows with a null lang train nothing; if
nothing can be learned every text is `und`; ties go to the language that sorts first. Rows without a doc_id are
left out; rows that share a doc_id are each reported. A letter is a character of Unicode category L.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SAMPLE_ROWS = 20_000
LEAST_ROWS = 100
SLOTS = 10**12
LONGEST = 5
#: scores of words that training has not seen are kept in each task, up to so many words and bytes
RECENT, RECENT_BYTES = 400_000, 32 << 20
STEP_BACK = math.log(0.4)
LETTERS = re.compile(r"[^\W\d_]+")
#: word characters that are numbers, not letters (category L): fractions, superscripts, circled and Roman numerals
NUMERALS = frozenset(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
OUT = "doc_id long, held_out boolean, lang_pred string, score double"


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and marked n-grams of each language, a part of them for each batch of rows."""
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(words_of(text))
        for lang, words in counts.items():
            grams: Counter = Counter()
            for word, n in words.items():
                for gram in grams_of(word):
                    grams[gram] += n
            for kind, found in (("w", words), ("g", grams)):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array([kind] * len(found)), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "kind", "item", "n"])


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    low = (text or "").lower()
    found = LETTERS.findall(low)
    if low.isascii():
        return found
    out: list[str] = []
    for word in found:  # few words hold a numeral, so only those are cut at it
        out.extend((word,) if NUMERALS.isdisjoint(word) else "".join(" " if c in NUMERALS else c for c in word).split())
    return out


def grams_of(word: str) -> Iterator[str]:
    marked = f"<{word}>"
    for size in range(1, LONGEST + 1):
        for i in range(len(marked) - size + 1):
            yield marked[i : i + size]


class Model:
    """Log frequencies by language: words and n-grams name rows of one table, whose row 0 is all zero."""

    def __init__(self, langs: list[str], words: dict[str, int], grams: dict[str, int], table: np.ndarray):
        self.langs, self.words, self.grams, self.table = langs, words, grams, table

    def known_grams(self, word: str) -> tuple[list[int], int]:
        """Rows of the word's longest known n-grams, and the steps back that they cost; row 0 if there are none."""
        marked = f"<{word}>"
        for size in range(LONGEST, 0, -1):
            found = [r for i in range(len(marked) - size + 1) if (r := self.grams.get(marked[i : i + size]))]
            if found:
                return found, LONGEST + 1 - size
        return [0], LONGEST

    def backed_off(self, words: list[str]) -> np.ndarray:
        """Scores of words that training has not seen."""
        found = [self.known_grams(w) for w in words]
        sizes = np.array([len(rows) for rows, _ in found])
        sums = np.add.reduceat(self.table[[r for rows, _ in found for r in rows]], np.cumsum(sizes) - sizes)
        return sums / sizes[:, None] + STEP_BACK * np.array([steps for _, steps in found])[:, None]

    def predictor(self) -> Callable[[str | None], tuple[str, float]]:
        words, recent = self.words, {}
        room = max(1000, min(RECENT, RECENT_BYTES // (8 * max(1, len(self.langs)))))
        scores = np.zeros((room, len(self.langs)))

        def predict(text: str | None) -> tuple[str, float]:
            counts = Counter(words_of(text))
            if not counts or not self.langs:
                return "und", 0.0
            known = {words[w]: n for w, n in counts.items() if w in words}
            total = np.fromiter(known.values(), float, len(known)) @ self.table[list(known)]
            unseen = [w for w in counts if w not in words]
            new = [w for w in unseen if w not in recent]
            if len(recent) + len(new) > room:
                recent.clear()
                new = unseen
            if len(new) > room:  # a text of more new words than there is room for
                total += np.array([counts[w] for w in unseen], float) @ self.backed_off(unseen)
            elif unseen:
                if new:
                    scores[len(recent) : len(recent) + len(new)] = self.backed_off(new)
                    recent.update(zip(new, range(len(recent), len(recent) + len(new)), strict=True))
                total += np.array([counts[w] for w in unseen], float) @ scores[[recent[w] for w in unseen]]
            best = int(total.argmax())
            odds = np.exp((total - total[best]) / max(1.0, sum(counts.values()) / 20))
            return self.langs[best], float(1.0 / odds.sum())

        return predict


def share_of(sizes: list[int], most: int) -> float:
    """Rows that a language may give so that all give `most`, LEAST_ROWS at least; without bound if all rows do."""
    left = most
    for k, size in enumerate(sorted(sizes)):
        if size * (len(sizes) - k) > left:
            return max(left / (len(sizes) - k), LEAST_ROWS)
        left -= size
    return math.inf


def train(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits the model on rows (doc_id, lang, text), on a hashed sample of each language if there are more than sample_rows."""
    sizes = dict(rows.groupBy("lang").count().collect())
    share = share_of(list(sizes.values()), sample_rows)
    limits = [F.lit(x) for lang, n in sizes.items() if lang is not None and n > share for x in (lang, int(SLOTS * share / n))]
    if limits:
        rows = rows.filter(F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(SLOTS)) < F.create_map(*limits)[F.col("lang")], F.lit(True)))
    found = rows.select("lang", "text").mapInArrow(_tally, "lang string, kind string, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(found["lang"].unique().to_pylist())
    names: list[dict[str, int]] = [{}, {}]
    parts = [np.zeros((1, len(langs)))]
    for known, kind in zip(names, "wg", strict=True):
        part = found.filter(pc.equal(found["kind"], kind))
        items = part["item"].combine_chunks().dictionary_encode()
        first = sum(map(len, parts))
        known.update((item, first + i) for i, item in enumerate(items.dictionary.to_pylist()))
        counts = np.zeros((len(known), len(langs)))
        counts[items.indices.to_numpy(), pc.index_in(part["lang"], pa.array(langs, pa.string())).to_numpy()] = part["n"].to_numpy()
        totals = counts.sum(0)
        parts.append(np.log((counts * (totals.mean() / totals) + 0.5) / (totals.mean() + 0.5 * len(known))) if len(known) else counts)
    return Model(langs, *names, np.concatenate(parts))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """lang_pred and score for each row of docs (doc_id, text), other columns dropped."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.words, model.grams, model.table))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Model(*shared.value).predictor()
        for batch in batches:
            found = [of(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(predict, OUT)


def op7_word_first_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("doc_id is not null").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 5 == 0).withColumn("doc_id", F.col("doc_id").cast("long"))
    model = train(docs.filter("not held_out and lang is not null and text is not null").select("doc_id", "lang", "text"))
    return identify(docs, model)
