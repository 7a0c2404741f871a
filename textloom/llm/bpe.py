"""Byte-level BPE by prefix dynamic programming.

A vocabulary's ranks decide one encoding for every byte string, and the encoding of each of its prefixes ends with
one token. That token is the only one that ends there and may follow the last token of the prefix before it: two
tokens may stand side by side if merging their bytes by rank gives back just these two. So one table of last tokens,
filled from left to right, holds the encodings of all prefixes. Bytes can be appended without another look at what
stands before, and after an edit the table is filled anew only until it agrees with the old one over the length of
the longest token.

A text is cut by the vocabulary's pattern first and each match is encoded by itself. A match that is a token is that
token, as in the public library, also where merging would not lead to it.

`encoded` gives each row's ids, `decoded` the bytes of ids. The vocabulary is read by the driver and broadcast: it
is as large as its file, whatever the corpus. Tasks keep the ids of recent matches, up to RECENT of them.

Defined cases: a null text is the empty text and has no tokens; strings of special tokens are plain text; repeated
rows and rows that share a doc_id are each encoded; an empty table gives an empty result. Texts of any length are cut
in blocks of matches, and a match of any length takes time in proportion to its bytes. Rows without a doc_id are
left out by the query. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .repeats import Batches

#: ids of up to twice so many recent matches, and verdicts on so many pairs of tokens, are kept in each task
RECENT, RECENT_PAIRS = 400_000, 1_000_000
#: matches of a long text that are encoded at a time, and the characters from which a text is long
BLOCK, LONG = 100_000, 1 << 20


class Vocabulary:
    """Tokens by id, and the two tokens whose merge makes each; a token that merging does not lead to has none."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        n = len(self.tokens)
        self.left, self.right = list(range(n)), list(range(n))
        self.merge: dict[tuple[int, int], int] = {}
        self.reached: dict[bytes, int] = {}
        for token in sorted(ranks, key=len):
            rank = ranks[token]
            halves = self.halves(token) if len(token) > 1 else ()
            if halves is None:
                continue
            if halves:
                self.left[rank], self.right[rank] = pair = ranks[halves[0]], ranks[halves[1]]
                self.merge[pair] = rank
            self.reached[token] = rank
        self.longest = max(map(len, self.reached), default=1)
        #: lengths of the tokens that end with the same three bytes, longest first; of two or one where no token does
        self.sizes: dict[bytes, tuple[int, ...]] = {}
        found: dict[bytes, set[int]] = {}
        for token in self.reached:
            found.setdefault(token[-3:], set()).add(len(token))
        for ending, sizes in found.items():
            shorter = {k for k in range(1, len(ending)) if ending[-k:] in self.reached}
            self.sizes[ending] = tuple(sorted(sizes | shorter, reverse=True))

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The last two parts left when the token's bytes are merged, least rank first; None if merging stops before."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.ranks]
            if not found:
                return None
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (parts[0], parts[1]) if all(p in self.ranks for p in parts) else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges of the bytes of a and b never cross from a to b.

        Taken apart in the reverse order of their merges, the two tokens show every pair that ever met at the seam:
        one that has a rank below that of the merges still ahead of it would have been merged.
        """
        merge, left, right, ahead = self.merge, self.left, self.right, len(self.tokens)
        while merge.get((a, b), ahead) >= ahead:
            whole_a, whole_b = right[a] == a, left[b] == b
            if whole_a and whole_b:
                return True
            # of the two the later merge is undone; of equal ones that of b, the merge further right
            if not whole_b and (whole_a or b >= a):
                ahead, b = b + 1, left[b]
            else:
                ahead, a = a, right[a]
        return False


def read_ranks(path: str) -> Vocabulary:
    """A vocabulary from a file of lines `base64 rank`."""
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))})


class PrefixTable:
    """The last token of every prefix of a byte string that grows and changes."""

    def __init__(self, vocabulary: Vocabulary, seen: dict[int, bool] | None = None):
        self.vocabulary = vocabulary
        #: verdicts on pairs of tokens
        self.seen = {} if seen is None else seen
        self.data, self.last = b"", []

    def _fill(self, enough: Callable[[int], bool] | None = None) -> None:
        """Last tokens of the prefixes that have none yet, until there is enough."""
        data, last, seen = self.data, self.last, self.seen
        sizes, tokens, n = self.vocabulary.sizes, self.vocabulary.reached, len(self.vocabulary.tokens)
        for end in range(len(last) + 1, len(data) + 1):
            for size in sizes.get(data[max(0, end - 3) : end]) or sizes.get(data[end - 2 : end]) or (1,):
                start = end - size
                if start < 0 or (token := tokens.get(data[start:end])) is None:
                    continue
                if not start:
                    break
                pair = last[start - 1] * n + token
                fits = seen.get(pair)
                if fits is None:
                    if len(seen) >= RECENT_PAIRS:
                        seen.clear()
                    fits = seen[pair] = self.vocabulary.compatible(last[start - 1], token)
                if fits:
                    break
            else:
                raise ValueError(f"no token for byte {data[end - 1]}")
            last.append(token)
            if enough and enough(end):
                return

    def append(self, more: bytes) -> PrefixTable:
        self.data += more
        self._fill()
        return self

    def become(self, data: bytes) -> PrefixTable:
        """Another string, which keeps what it has in common with the old one at its start."""
        common = 0
        for a, b in zip(self.data, data, strict=False):
            if a != b:
                break
            common += 1
        del self.last[common:]
        self.data = data
        self._fill()
        return self

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts new in the place of the bytes from start to end; the number of prefixes that were looked at anew.

        A last token depends on those of the LONGEST prefixes before it and on the bytes between, so once that many
        in a row are as they were, all others are.
        """
        tail, same, moved = self.last[end:], 0, start + len(new)
        self.data = self.data[:start] + new + self.data[end:]
        del self.last[start:]

        def agrees(at: int) -> bool:
            nonlocal same
            same = same + 1 if at > moved and self.last[at - 1] == tail[at - 1 - moved] else 0
            return same >= self.vocabulary.longest

        self._fill(agrees)
        made = len(self.last) - start
        self.last += tail[len(self.last) - moved :]
        return made

    def ids(self, length: int | None = None) -> list[int]:
        """Ids of the whole string, or of its first `length` bytes."""
        out, at, tokens = [], len(self.data) if length is None else length, self.vocabulary.tokens
        while at:
            out.append(self.last[at - 1])
            at -= len(tokens[out[-1]])
        return out[::-1]


class Encoder(dict):
    """Packed ids of each match of the pattern; the most recent ones are kept."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        super().__init__()
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.table = PrefixTable(vocabulary)
        self.older: dict[str, bytes] = {}

    def __missing__(self, match: str) -> bytes:
        packed = self.older.get(match)
        if packed is None:
            data = match.encode()
            whole = self.vocabulary.ranks.get(data)
            packed = np.array(self.table.become(data).ids() if whole is None else [whole], np.int32).tobytes()
        if len(packed) <= 1024:
            if len(self) >= RECENT:  # what was met since the last turn stays for another one
                self.older = dict(self)
                self.clear()
            self[match] = packed
        return packed

    def blocks(self, text: str) -> Iterator[list[str]]:
        """The text's matches, those of a long one a block at a time."""
        if len(text) < LONG:
            yield self.pattern.findall(text)
            return
        found = (m[0] for m in self.pattern.finditer(text))
        while block := list(islice(found, BLOCK)):
            yield block

    def packed(self, text: str) -> bytes:
        return b"".join(b"".join(map(self.__getitem__, block)) for block in self.blocks(text))

    def packed_all(self, texts: Iterable[str]) -> list[bytes]:
        """Of several short texts; matches not met before are encoded in their order, so that neighbours share prefixes."""
        found = [self.pattern.findall(t) if len(t) < LONG else None for t in texts]
        for match in sorted({m for matches in found if matches for m in matches} - self.keys()):
            self[match]
        return [self.packed(t) if matches is None else b"".join(map(self.__getitem__, matches)) for t, matches in zip(texts, found, strict=True)]

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()


class EncodedText:
    """A text that is edited: only the matches that an edit touches are cut and encoded anew."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder = encoder
        self.matches: list[str] = encoder.pattern.findall(text)

    @property
    def text(self) -> str:
        return "".join(self.matches)

    def ids(self) -> list[int]:
        return np.frombuffer(b"".join(map(self.encoder.__getitem__, self.matches)), np.int32).tolist()

    def append(self, more: str) -> None:
        n = sum(map(len, self.matches))
        self.replace(n, n, more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Puts new in the place of the characters from start to end; the number of matches that were made anew.

        A match may depend on what follows the two matches after it, as the pattern's longest fixed string has three
        characters, so cutting begins three matches before the edit. It ends where a cut meets an old one.
        """
        ends, at, first = [], 0, 0
        for k, match in enumerate(self.matches):
            at += len(match)
            ends.append(at)
            if at < start:
                first = k + 1
        first = max(0, first - 3)
        begin = ends[first - 1] if first else 0
        rest = self.text[begin:]
        rest = rest[: start - begin] + new + rest[end - begin :]
        moved = {e - (end - start) + len(new): k for k, e in enumerate(ends) if e >= end}
        made = []
        for found in self.encoder.pattern.finditer(rest):
            made.append(found[0])
            if (k := moved.get(begin + found.end())) is not None and found.end() + begin > start + len(new):
                self.matches[first : k + 1] = made
                break
        else:
            self.matches[first:] = made
        return len(made)


def token_lists(packed: Iterable[bytes]) -> pa.ListArray:
    packed = list(packed)
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def encoded(docs: DataFrame, vocabulary: Vocabulary, pattern: str) -> DataFrame:
    """doc_id and ids, an array of token ids, for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches: Batches) -> Batches:
        of = Encoder(shared.value, pattern)
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                yield pa.RecordBatch.from_arrays([part["doc_id"], token_lists(of.packed_all([t or "" for t in part["text"].to_pylist()]))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """rows (doc_id, ids) with `bytes`, what the ids stand for."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary.tokens)

    def decode(batches: Batches) -> Batches:
        tokens = shared.value
        for batch in batches:
            found = [b"".join(map(tokens.__getitem__, ids.values.to_numpy().tolist())) if ids.is_valid else b"" for ids in batch["ids"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["ids"], pa.array(found, pa.binary())], ["doc_id", "ids", "bytes"])

    return rows.select("doc_id", "ids").mapInArrow(decode, "doc_id long, ids array<int>, bytes binary")


def op13_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").filter("doc_id is not null")
    rows = decoded(encoded(docs, vocabulary, public_tokenizers.PATTERN), vocabulary)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
