"""Cross-tokenizer alignment by a sweep over the ends of tokens.

Two tokenizers A and B cut the same bytes, a space and the text. Every byte offset at which a token ends is an event.
The events of A and of B are put together, dealt by document, sorted by offset inside the partitions, and read in that
order by a state machine:

- where tokens of both sides end, a group closes: the tokens since the last such offset belong together;
- between two events next to each other there is one open token on each side, and these two overlap: a link.

An event row holds a run of ends of one side, up to BLOCK bytes of the text, packed as the ids of its tokens: their
lengths give the offsets. Ends at one offset stand in runs of the same block, so the machine never looks back. Its state
is the open tokens, of which the longest token bounds the number, and the ids of the open group, which the form of
a group wants together. A run's work is in proportion to its events, also where no group closes for long.

Documents give their distinct pairs of linked ids with the times each is linked. Corpus-wide counts of pairs are sums
of these; a pair table of up to BROADCAST_PAIRS rows is broadcast, a larger one is joined by a shuffle.

Defined cases: null and empty texts, and texts that a tokenizer doesn't give back byte for byte (B writes U+2581 for a
space), have no tokens: all numbers are 0 and the digest is ''. Strings of special tokens are plain text. Repeated rows
and rows that share a doc_id are each aligned and each count in the corpus. Rows without a doc_id are left out by the
query. An empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage, table
from .repeats import Batches

#: bytes of text whose ends stand in one event row
BLOCK = 1 << 16
#: pairs that one row of a document gives at most before another row begins
PAIRS = 1 << 20
#: rows of the corpus's pair table (17 bytes each) up to which it is broadcast
BROADCAST_PAIRS = 1_000_000
EVENTS = "row long, doc_id long, block long, side int, ids binary"


class Tokenizer(Protocol):
    """The bytes of each token, and for each of several texts the ids of a space and the text."""

    tokens: list[bytes]

    def encode_all(self, texts: list[str]) -> list[Sequence[int]]: ...


class ByteLevel:
    """A byte-level BPE file of vocabulary and merges. Its ids must rise with its merges, so that they are ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        special = {t["content"] for t in read["added_tokens"]}
        vocabulary, merges = read["model"]["vocab"], read["model"]["merges"]
        made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        if made != sorted(made):
            raise ValueError(f"{path}: ids do not rise with the merges")
        # printable bytes stand for themselves, the others for the code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        self.tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in self.ranks.items():
            self.tokens[i] = token
        self.pattern, self._library = pattern, None

    def __getstate__(self):
        return {**self.__dict__, "_library": None}

    def encode_all(self, texts: list[str]) -> list[Sequence[int]]:
        if self._library is None:
            import tiktoken

            self._library = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        return [self._library.encode_ordinary(" " + t) for t in texts]


class Pieces:
    """A sentencepiece model, which puts the space before the text by itself."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.model = f.read()
        self._library = None
        model = self._loaded()
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.tokens = [bytes([int(n[3:-1], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]

    def __getstate__(self):
        return {**self.__dict__, "_library": None}

    def _loaded(self):
        if self._library is None:
            import sentencepiece

            self._library = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        return self._library

    def encode_all(self, texts: list[str]) -> list[Sequence[int]]:
        return self._loaded().encode(texts)


def lengths(tokenizer: Tokenizer) -> np.ndarray:
    return np.array([len(t) for t in tokenizer.tokens], np.int64)


def packed_type(tokenizer: Tokenizer) -> type:
    return np.uint16 if len(tokenizer.tokens) <= 1 << 16 else np.uint32


def events(docs: DataFrame, a: Tokenizer, b: Tokenizer) -> DataFrame:
    """EVENTS of each row of docs (doc_id, text); a row without tokens has one run of none."""
    shared = docs.sparkSession.sparkContext.broadcast((a, b))

    def runs(text: str, *found: Sequence[int]) -> Iterator[tuple[int, int, bytes]]:
        whole = b" " + text.encode()
        found = [np.asarray(ids, packed_type(t)) for t, ids in zip(shared.value, found, strict=True)] if text else []
        if not all(b"".join(map(t.tokens.__getitem__, ids.tolist())) == whole for t, ids in zip(shared.value, found, strict=False)):
            found = []
        if not found:
            yield 0, 0, b""
        for side, packed in enumerate(found):
            if len(whole) <= BLOCK:
                yield 0, side, packed.tobytes()
                continue
            blocks = (np.cumsum(sizes[side][packed]) - 1) // BLOCK
            starts = np.flatnonzero(np.diff(blocks, prepend=-1)).tolist()
            for first, end in zip(starts, [*starts[1:], len(packed)], strict=True):
                yield int(blocks[first]), side, packed[first:end].tobytes()

    sizes = [lengths(a), lengths(b)]

    def scan(batches: Batches) -> Batches:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                texts = [t or "" for t in part["text"].to_pylist()]
                each = zip(part["row"].to_pylist(), part["doc_id"].to_pylist(), texts, *(t.encode_all(texts) for t in shared.value), strict=True)
                out = [(row, doc_id, *run) for row, doc_id, *text in each for run in runs(*text)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["row", "doc_id", "block", "side", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, EVENTS)


def decimal_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The digits of 0 to n - 1, each number's in the low bytes of eight, and the bits that they take."""
    if n > 10**7:
        raise ValueError("ids of at most seven digits")
    text = [str(k).encode() for k in range(n)]
    return np.frombuffer(b"".join(t.ljust(8, b"\0") for t in text), "<u8"), np.array([8 * len(t) for t in text], np.uint64)


class Sweep:
    """The state machine: takes the runs of one document block by block."""

    def __init__(self, sizes: tuple[np.ndarray, np.ndarray]):
        self.sizes, self.n_b = sizes, len(sizes[1])
        self.digits, self.bits = decimal_table(max(map(len, sizes)))
        self.wide = np.int32 if len(sizes[0]) * len(sizes[1]) < 1 << 31 else np.int64
        self.begin()

    def begin(self) -> None:
        self.at = [0, 0]
        self.open: tuple[list, list] = ([], [])
        self.waiting: tuple[list, list] = ([], [])
        self.digest, self.any_group = hashlib.sha256(), False
        self.counts = [0, 0, 0, 0]
        self.linked: list[np.ndarray] = []

    def feed(self, ids: tuple[np.ndarray, np.ndarray]) -> bytes:
        """Takes the next block's ids of both sides; returns the text of the groups that closed."""
        ends = []
        for side in (0, 1):
            ends.append(self.at[side] + np.cumsum(self.sizes[side][ids[side]]))
            self.counts[side] += len(ids[side])
        first = min(self.at)
        self.at = [int(e[-1]) if len(e) else at for e, at in zip(ends, self.at, strict=True)]
        # the block's bytes: 1 where a token of A ends, 2 where one of B does, 3 where both do
        marks = np.zeros(max(self.at) - first + 1, np.uint8)
        marks[ends[0] - first] = 1
        marks[ends[1] - first] += 2
        kind = marks[np.flatnonzero(marks)]
        # of each event and side, the place of the token that ends there or is open there
        ended = kind & 1, kind >> 1
        index = [np.cumsum(e, dtype=np.int64) - e for e in ended]
        self._link(ids, index, ended)
        return self._close(ids, index, kind == 3)

    def _link(self, ids, index, ended) -> None:
        for side in (0, 1):  # what ended while the other side's token was open meets that token now
            other = 1 - side
            if self.waiting[side] and len(ids[other]):
                waited = np.concatenate(self.waiting[side])
                met = np.full(len(waited), ids[other][0])
                self._count(*((met, waited) if side else (waited, met)))
                self.waiting[side].clear()
        # one side may have a token that ends in a later block: those of the other that end within it wait
        n = min(int(np.searchsorted(index[side], len(ids[side]))) for side in (0, 1))
        self._count(ids[0][index[0][:n]], ids[1][index[1][:n]])
        for side in (0, 1):
            left = index[side][n:][ended[side][n:] != 0]
            if len(left):
                self.waiting[side].append(ids[side][left])

    def _count(self, a: np.ndarray, b: np.ndarray) -> None:
        self.counts[3] += len(a)
        self.linked.append(a.astype(self.wide) * self.wide(self.n_b) + b)

    def _close(self, ids, index, both) -> bytes:
        n = int(np.count_nonzero(both))
        last = []
        for side in (0, 1):
            before = sum(map(len, self.open[side])) if n else 0
            last.append(before + index[side][both])
            self.open[side].append(ids[side])
        if not n:
            return b""
        whole = [np.concatenate(x) for x in self.open]
        for side in (0, 1):
            self.open[side][:] = [whole[side][last[side][-1] + 1 :]]
        # a group's tokens of A stand before its tokens of B, groups one after the other
        sizes = [np.diff(x, prepend=-1) for x in last]
        ends_of_a = last[0] + last[1] + 1 - sizes[1]
        order = np.empty(int(last[0][-1] + last[1][-1]) + 2, np.int64)
        of_a = np.repeat(np.tile([True, False], n), np.stack(sizes, 1).ravel())
        order[of_a], order[~of_a] = (whole[side][: last[side][-1] + 1] for side in (0, 1))
        mark = np.full(len(order), ord(","), np.uint64)
        mark[ends_of_a], mark[last[0] + last[1] + 1] = ord("|"), ord(";")
        written = self.digits[order] | mark << self.bits[order]
        text = written.tobytes().translate(None, b"\0")[:-1]
        self.counts[2] += n
        self.digest.update(b";" + text if self.any_group else text)
        self.any_group = True
        return text

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs since the last call, and the times each was linked."""
        found = np.unique(np.concatenate(self.linked), return_counts=True) if self.linked else (np.zeros(0, self.wide), np.zeros(0, np.int64))
        self.linked.clear()
        return found

    def many(self) -> bool:
        return sum(map(len, self.linked)) >= PAIRS


def sweep(found: DataFrame, a: Tokenizer, b: Tokenizer, text: bool = False) -> DataFrame:
    """Rows (row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times, groups) of the events found.

    A row closes a document, or holds a part of its pairs and numbers where there are very many: numbers are to be
    summed by `row`, and only the closing row has the digest. groups: the text of the groups that the row closes, one
    row for each block then, null unless asked for.
    """
    sizes = lengths(a), lengths(b)
    types = packed_type(a), packed_type(b)
    of_pairs = "int" if len(sizes[0]) * len(sizes[1]) < 1 << 31 else "long"
    out = f"row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{of_pairs}>, times array<int>, groups string"

    def run(batches: Batches) -> Batches:
        machine = Sweep(sizes)
        rows: list[tuple] = []
        at, block, ids, begun = None, None, [b"", b""], [0, 0, 0, 0]

        def fed() -> str | None:
            nonlocal ids
            closed = machine.feed(tuple(np.frombuffer(x, t) for x, t in zip(ids, types, strict=True)))
            ids = [b"", b""]
            return closed.decode() if text else None

        def put(closing: bool, groups: str | None) -> None:
            numbers = [x - y for x, y in zip(machine.counts, begun, strict=True)]
            begun[:] = machine.counts
            digest = (machine.digest.hexdigest() if machine.counts[0] else "") if closing else None
            rows.append((*at, *numbers, digest, *machine.pairs(), groups))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [*[pa.int64()] * 6, pa.string(), pa.list_(pa.int32() if of_pairs == "int" else pa.int64()), pa.list_(pa.int32()), pa.string()]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "groups"])

        for batch in batches:
            for row, doc_id, new_block, side, packed in zip(*(batch[c].to_pylist() for c in ("row", "doc_id", "block", "side", "ids")), strict=True):
                if at is not None and (row != at[0] or new_block != block):
                    closed = fed()
                    if row != at[0] or text or machine.many():
                        put(row != at[0], closed)
                if at is None or row != at[0]:
                    machine.begin()
                    begun[:] = machine.counts
                    at = (row, doc_id)
                block = new_block
                ids[side] = packed
                if len(rows) >= 1000 or rows and sum(len(r[7]) for r in rows[-50:]) >= PAIRS:
                    yield batch_of()
        if at is not None:
            put(True, fed())
        if rows:
            yield batch_of()

    dealt = found.repartition("row").sortWithinPartitions("row", "block", "side")
    return dealt.mapInArrow(run, out)


def pair_counts(swept: DataFrame, n_b: int) -> DataFrame:
    """(pair, count, best): the links of each pair in all documents, and whether no pair of its B id has more."""
    each = swept.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(F.col("p.pairs").cast("long").alias("pair"), F.col("p.times").cast("long").alias("times"))
    counts = each.groupBy("pair").agg(F.sum("times").alias("count"))
    # the tokens of A bound the rows of one B id
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(F.col("pair") % n_b)))


def aligned(docs: DataFrame, a: Tokenizer, b: Tokenizer) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs (doc_id, text)."""
    swept = stage(sweep(events(docs, a, b), a, b).drop("groups"), heavy=True)
    counts = stage(pair_counts(swept, len(b.tokens)))
    known = F.broadcast(counts) if counts.count() <= BROADCAST_PAIRS else counts.hint("merge")
    each = swept.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").cast("long").alias("pair"), F.col("p.times").cast("long").alias("times"))
    scored = each.join(known, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    sums = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")]
    whole = swept.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *sums, F.max("groups_sha256").alias("groups_sha256"))
    out = whole.join(scored.hint("merge"), "row", "left").fillna(0, ["n_best", "count_sum"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_event_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a = ByteLevel(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    b = Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return aligned(table(spark, sf_dir, "documents").filter("doc_id is not null"), a, b)
