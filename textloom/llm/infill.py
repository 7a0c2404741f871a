"""Fill-in-middle transformation over an index of the distinct texts.

1. Identical texts are grouped by their whole content, which Spark compares byte for byte; each task first groups its
   own rows, so a text that a third of all rows share leaves a task once.
2. For each distinct text the ends of its lines, in code points, are kept as an Elias-Fano list: the low bits of each
   end as they are, the high bits as gaps in unary code. It takes about two bits more than log2(length / lines) a line
   and gives the k-th end without decoding the others.
3. The lists are joined back to the documents by the SHA-256 of the text, and each document's seeded numbers select
   its two cuts. The join carries the lists, which are small; Spark splits its hot keys.

Forms: plain, the text as it is; psm, prefix, suffix, middle; spm, suffix, prefix, middle, each after its marker.
`restored` gives the text back from the output and its form.

Defined cases: a null text is the empty text; the empty text, a text that holds a marker, and one outside the share
to transform are plain; a text without line breaks is one line, so a cut takes all or nothing of it. Rows that share
a doc_id have the same seeds, and repeated rows the same result; rows without a doc_id are left out. An empty table
gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stage, table, text_bytes
from .repeats import Batches, sha256

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: percent of the texts to transform, percent of those in the form spm
SHARE, SPM_SHARE = 100, 50
SEED = "7"
LISTS = "digest binary, n long, low_bits int, low binary, high binary"
OUT = "doc_id long, text string, n long, form string, prefix_chars long, middle_chars long, output string"


def packed_list(ends: np.ndarray) -> tuple[int, bytes, bytes]:
    """Elias-Fano parts of a rising list of positive numbers: bits of each low part, low parts, high parts in unary."""
    if not len(ends):
        return 0, b"", b""
    bits = max(0, int(ends[-1] // len(ends)).bit_length() - 1)
    low = (ends[:, None] >> np.arange(bits)[None, :]) & 1
    high = np.zeros((int(ends[-1]) >> bits) + len(ends), np.uint8)
    high[(ends >> bits) + np.arange(len(ends))] = 1
    return bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()


_ONES = np.array([bin(k).count("1") for k in range(256)], np.uint8)


def selected(k: int, bits: int, low: bytes, high: bytes) -> int:
    """The k-th number of the list, from 0 on."""
    packed = np.frombuffer(high, np.uint8)
    ones = np.cumsum(_ONES[packed], dtype=np.int64)
    at = int(np.searchsorted(ones, k + 1))
    rest = k - (int(ones[at - 1]) if at else 0)
    place = 8 * at + int(np.flatnonzero(np.unpackbits(packed[at : at + 1], bitorder="little"))[rest])
    first = k * bits
    window = int.from_bytes(low[first >> 3 : (first + bits + 7) >> 3], "little") >> (first & 7)
    return (place - k) << bits | window & ((1 << bits) - 1)


def line_ends(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text, standing end to end in data, the number of code points up to the end of each of its lines."""
    begins = (data & 0xC0) != 0x80
    upto = np.cumsum(begins, dtype=np.int64)
    breaks = np.flatnonzero(data == 10)
    out = []
    for first, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = breaks[np.searchsorted(breaks, first) : np.searchsorted(breaks, end)]
        before = upto[first - 1] if first else 0
        ends = upto[own] - before
        if end > first and data[end - 1] != 10:
            ends = np.append(ends, upto[end - 1] - before)
        out.append(ends)
    return out


def _lists(batches: Batches) -> Batches:
    for batch in batches:
        data, offsets = text_bytes(batch["text"])
        for first, end in slices(offsets):
            lo, hi = offsets[first], offsets[end]
            ends = line_ends(data[lo:hi], offsets[first : end + 1] - lo)
            parts = [packed_list(e) for e in ends]
            columns = [pa.array([len(e) for e in ends], pa.int64()), pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary()), pa.array([p[2] for p in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch["digest"].slice(first, end - first), *columns], ["digest", "n", "low_bits", "low", "high"])


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def text_index(texts: DataFrame) -> DataFrame:
    """LISTS for each distinct text of texts (text)."""
    return texts.select("text").distinct().select(digest(F.col("text")).alias("digest"), "text").mapInArrow(_lists, LISTS)


def seeded(doc_id: Column, k: int, seed: str = SEED) -> Column:
    """The k-th number, from 0 on, of the row: eight hex digits of a SHA-256 of seed and doc_id."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 8 * k + 1, 8), 16, 10).cast("long")


def arranged(text: str, form: str, first: int, second: int) -> str:
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}" if form == "spm" else text


def restored(output: str, form: str) -> str:
    """The text that an output was made of; texts hold no markers, so the first of each ends the part before it."""
    if form == "plain":
        return output
    one, rest = output[len(PREFIX) :].split(SUFFIX if form == "psm" else PREFIX, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == "psm" else two + middle + one


def _cut(batches: Batches) -> Batches:
    for batch in batches:
        for first in range(0, batch.num_rows, 1000):
            part = batch.slice(first, 1000)
            chars, outputs = [], []
            for row in part.to_pylist():
                ends = [selected(row[c] - 1, row["low_bits"], row["low"], row["high"]) if row[c] and row["form"] != "plain" else 0 for c in ("from_line", "to_line")]
                chars.append([None, None] if row["form"] == "plain" else [ends[0], ends[1] - ends[0]])
                outputs.append(arranged(row["text"], row["form"], *ends))
            columns = [pa.array([c[0] for c in chars], pa.int64()), pa.array([c[1] for c in chars], pa.int64()), pa.array(outputs, pa.string())]
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["text"], part["n"], part["form"], *columns], ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"])


def infilled(docs: DataFrame, share: int = SHARE, spm_share: int = SPM_SHARE, seed: str = SEED) -> DataFrame:
    """OUT for each row of docs (doc_id, text): its cuts and the transformed text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    index = stage(text_index(docs.select("text")), heavy=True)
    rows = docs.withColumn("own", digest(F.col("text"))).join(index.hint("merge"), F.col("own") == F.col("digest"))
    h = [seeded(F.col("doc_id"), k, seed) for k in range(4)]
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (h[2] % 100 >= share)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_share, "spm").otherwise("psm")
    one, two = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    rows = rows.select("doc_id", "text", "n", form.alias("form"), F.least(one, two).alias("from_line"), F.greatest(one, two).alias("to_line"), "low_bits", "low", "high")
    return rows.mapInArrow(_cut, OUT)


def _restored(batches: Batches) -> Batches:
    for batch in batches:
        found = [sha256(restored(o, f).encode()) for o, f in zip(batch["output"].to_pylist(), batch["form"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names if c != "output"), pa.array(found, pa.string())], [c for c in batch.schema.names if c != "output"] + ["restored_sha256"])


def op11_infill_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = infilled(table(spark, sf_dir, "documents").filter("doc_id is not null"))
    rows = rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), "output")
    return rows.mapInArrow(_restored, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


SQL = r"""WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text, sha256('7:' || CAST(CAST(doc_id AS BIGINT) AS VARCHAR)) AS h FROM documents WHERE doc_id IS NOT NULL),
l AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS p, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS q,
CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
s AS (SELECT *, array_to_string(lines[1:p], '') AS prefix, array_to_string(lines[p+1:q], '') AS middle, array_to_string(lines[q+1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
sha256(text) AS restored_sha256 FROM s"""
