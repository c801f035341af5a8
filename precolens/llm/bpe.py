"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The queue holds, for each merge rank, the list positions whose pair has it; a two-level bitmap of
ranks gives the next one by find-first-set. A merge only links neighbours anew and queues their pairs;
entries whose pair has changed since are skipped. The work grows with the length of a pre-token, not
with its square.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precolens.llm.common import Cache, free_name, kept, ready, slices

CACHED_GROUPS, CACHED_WORDS = 150_000, 150_000
# Pre-tokens that go through the queue together.
_RUN = 16_384
_BITS = 256
_INNER_SPACE = re.compile(r"\s (?:\s|\Z)")


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks file: a line for each token, its bytes in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def groups(text: str, pattern: regex.Pattern) -> list[str]:
    """The text cut before spaces; each group's matches of ``pattern`` are matches in the whole text.

    A space starts a new match if the character before it is not white space, or if the one after is
    there and not white space. Texts that have another space are cut into the matches themselves.
    """
    if "\0" in text or _INNER_SPACE.search(text):
        return pattern.findall(text)
    return text.replace(" ", "\0 ").split("\0")


class RankQueue:
    """Positions by rank, with a bitmap of the ranks that hold any and one of that bitmap's words."""

    def __init__(self, ranks: int):
        self.inner = [0] * (ranks // _BITS + 1)
        self.outer = 0
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if not bucket:
            self.inner[rank // _BITS] |= 1 << rank % _BITS
            self.outer |= 1 << rank // _BITS
        bucket.append(position)

    def first(self) -> int:
        """The smallest rank that holds any position."""
        word = (self.outer & -self.outer).bit_length() - 1
        bits = self.inner[word]
        return word * _BITS + (bits & -bits).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """The positions of ``rank``, leftmost first; they leave the queue."""
        word = rank // _BITS
        self.inner[word] &= ~(1 << rank % _BITS)
        if not self.inner[word]:
            self.outer &= ~(1 << word)
        bucket, self.buckets[rank] = self.buckets[rank], []
        bucket.sort()
        return bucket


class Encoder:
    """Ids of texts by the ranks of a vocabulary of byte strings, which has all single bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        inside = set(b"".join(t for t in ranks if len(t) > 1))
        # A byte that UTF-8 text never has and that no merge takes keeps words apart in one run.
        self.separator = next((bytes([b]) for b in range(0xFF, 0xF4, -1) if b not in inside), None)
        self.words = Cache(self.merge_all, CACHED_WORDS)
        self.groups = Cache(self._group_ids, CACHED_GROUPS)

    def merge(self, word: bytes) -> list[int]:
        """The ids of ``word`` when its pairs are merged by rank, the leftmost first."""
        ranks, queue, n = self.ranks, self.queue, len(word)
        after, before = [*range(1, n + 1), n], [*range(-1, n)]
        pair = [ranks.get(word[i : i + 2]) for i in range(n - 1)]
        pair.append(None)
        get, push, buckets = ranks.get, queue.push, queue.buckets
        for i, rank in enumerate(pair):
            if rank is not None:
                push(rank, i)
        while queue.outer:
            rank = queue.first()
            bucket = queue.take(rank)
            for at, i in enumerate(bucket):
                if pair[i] != rank:
                    continue  # the pair has changed since
                middle = after[i]
                end = after[middle]
                after[i], before[end], pair[middle], pair[i] = end, i, None, None
                lowest = rank + 1
                if end < n:
                    new = pair[i] = get(word[i : after[end]])
                    if new is not None:
                        if buckets[new]:
                            buckets[new].append(i)
                        else:
                            push(new, i)
                        lowest = new
                left = before[i]
                if left >= 0:
                    new = pair[left] = get(word[left:end])
                    if new is not None:
                        if buckets[new]:
                            buckets[new].append(left)
                        else:
                            push(new, left)
                        if new < lowest:
                            lowest = new
                if lowest <= rank:
                    for rest in bucket[at + 1 :]:
                        push(rank, rest)
                    break
        ids, i = [], 0
        while i < n:
            ids.append(ranks[word[i : after[i]]])
            i = after[i]
        return ids

    def merge_all(self, words: list[str]) -> list[bytes]:
        """The ids of each pre-token; those that are no token themselves go through the queue together."""
        coded = [w.encode() for w in words]
        ids = [self.ranks.get(w) for w in coded]
        split = [w for w, i in zip(coded, ids, strict=True) if i is None]
        if self.separator is None:
            merged = iter([array("I", self.merge(w)) for w in split])
        else:
            merged = iter(self._merge_joined(split))
        return [(next(merged) if i is None else array("I", (i,))).tobytes() for i in ids]

    def _merge_joined(self, words: list[bytes]) -> list[array]:
        out: list[array] = []
        between = self.ranks[self.separator]
        for at in range(0, len(words), _RUN):
            ids, start = self.merge(self.separator.join([*words[at : at + _RUN], b""])), 0
            for _ in words[at : at + _RUN]:
                end = ids.index(between, start)
                out.append(array("I", ids[start:end]))
                start = end + 1
        return out

    def _group_ids(self, new: list[str]) -> list[bytes]:
        cut = [self.pattern.findall(g) for g in new]
        ids = iter(self.words.get([w for words in cut for w in words]))
        return [b"".join(islice(ids, len(words))) for words in cut]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut = [groups(t, self.pattern) if t else [] for t in texts]
        ids = iter(self.groups.get([g for found in cut for g in found]))
        return [b"".join(islice(ids, len(found))) for found in cut]


def _encoder(path: str, pattern: str) -> Encoder:
    return kept((path, pattern), lambda: Encoder(read_ranks(path), pattern))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` and a binary column of its texts' ids, little-endian unsigned 32-bit integers.

    Each match of ``pattern`` in the whole text is encoded separately by the ranks at ``path``; no
    string is special. A null or empty text has no ids. The column's name is lengthened if ``docs``
    has it; rows, ids and other columns stay as they are.
    """
    name, text = free_name(docs, out), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in slices(batches, text):
            ids = encoder.encode_all(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], [*batch.schema.names, name])

    return ready(docs).mapInArrow(run, _fields(docs) + f", {name} binary")


def decode(rows: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` and a binary column of the bytes that their ids stand for; null ids give null.

    An id that the vocabulary does not have raises a KeyError.
    """
    name, ids = free_name(rows, out), rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = kept((path, "tokens"), lambda: {rank: token for token, rank in read_ranks(path).items()})
        for batch in slices(batches, ids):
            texts = [
                None if b is None else b"".join(map(tokens.__getitem__, memoryview(b).cast("I")))
                for b in batch.column(ids).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, name])

    return ready(rows).mapInArrow(run, _fields(rows) + f", {name} binary")


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in df.dtypes)


def digests(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of encoded and decoded rows."""
    return coded.select(
        id_col,
        (F.octet_length(ids_col) / 4).cast("long").alias("n_tokens"),
        F.sha2(ids_col, 256).alias("ids_sha256"),
        F.sha2(decoded_col, 256).alias("decoded_sha256"),
    )
