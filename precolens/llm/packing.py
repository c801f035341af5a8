"""Packing of tokenised documents into sequences by shortest-pack-first over the length histogram.

Documents are cut into whole sequences and one rest. The histogram of piece lengths is all that the
packing looks at: lengths are placed longest first, each into the packs with the most space left, as
counts of packing patterns. Pieces of a length are then numbered, and their numbers lead them to
pattern, sequence and offset.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precolens.llm.common import Cache, kept, raw, ready, slices, tokenizer_at
from precolens.session import written

CAPACITY = 2048
END_ID = 1
CACHED_WORDS = 250_000

# Punctuation that ends words and is no part of them.
_MARKS = ",.;:!?"
# How byte-level models write the bytes of a text: printable ones as themselves, others from 256 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_LETTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}

# The settings of a tokenizer file under which a text's ids are those of its words: white space separates and is
# dropped, letters are lower case, runs of letters are words, and bytes are written as above.
_NORMAL = ["NFC", {"Regex": "\\s+"}, " ", "Lowercase"]
_WORDS = ["'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+", "Removed", True, "ByteLevel", False, False]

Pattern = tuple[int, list[tuple[int, int]]]  # how many sequences; (length, times) in each


def cuts_words(path: str) -> bool:
    """Whether the tokenizer at ``path`` has the settings under which a text's ids are those of its words."""
    file = json.loads(Path(path).read_text("utf-8"))
    try:
        first, space, lower = file["normalizer"]["normalizers"]
        cut, letters = file["pre_tokenizer"]["pretokenizers"]
        normal = [first["type"], space["pattern"], space["content"], lower["type"]]
        words = [cut["pattern"]["Regex"], cut["behavior"], cut["invert"], letters["type"], letters["add_prefix_space"], letters["use_regex"]]
    except (KeyError, TypeError, ValueError):  # other settings
        return False
    spaced = any(c.isspace() for t in file["added_tokens"] for c in t["content"])
    return [normal, words] == [_NORMAL, _WORDS] and file["model"]["type"] == "BPE" and not spaced


class WordIds:
    """Ids, as little-endian unsigned 32-bit integers, of texts.

    If the tokenizer drops white space before it splits words, a text's ids are those of its parts. Of
    a part that is letters and then marks, the letters are one word; its ids are the model's own. Any
    other tokenizer gets whole texts. Texts given together are looked up by their distinct parts and words.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        self.tokenizer = tokenizer_at(path)
        self.in_parts = cuts_words(path)
        self.special = any("<" not in t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.words = Cache(self._of_words, cached)
        self.parts = Cache(self._of_parts, cached)

    def _of_words(self, words: list[str]) -> list[bytes]:
        tokenize = self.tokenizer.model.tokenize
        found = []
        for word in words:
            letters = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
            found.append(array("I", [t.id for t in tokenize(letters)]).tobytes())
        return found

    def _whole(self, parts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _of_parts(self, parts: list[bytes]) -> list[bytes]:
        out: list = [None] * len(parts)
        words, marks, simple, other = [], [], [], []
        for i, part in enumerate(parts):
            text = part.decode("utf-8", "replace")
            core = text.rstrip(_MARKS)
            word = normalize("NFC", core).lower()
            # One word of letters, whose lower case is one, too; a capital sigma has two of those.
            if core.isalpha() and word.isalpha() and "\u03a3" not in core and not self.special:
                words.append(word)
                marks.append(text[len(core) :])
                simple.append(i)
            else:
                other.append(i)
        kinds = sorted(set(marks))
        ends = dict(zip(kinds, self._whole(kinds), strict=True))
        for i, ids, mark in zip(simple, self.words.get(words), marks, strict=True):
            out[i] = ids + ends[mark]
        for i, ids in zip(other, self._whole([parts[i].decode("utf-8", "replace") for i in other]), strict=True):
            out[i] = ids
        return out

    def _of_distinct(self, parts: pa.StringArray) -> pa.LargeBinaryArray:
        """Ids of distinct parts: ASCII letters and then marks by their words, others by the cache of parts."""
        core = pc.ascii_rtrim(parts, characters=_MARKS)
        simple = pc.ascii_is_alpha(core).to_numpy(zero_copy_only=False) & (not self.special)
        words = pc.ascii_lower(core.filter(pa.array(simple))).dictionary_encode()
        texts, lengths = _listed(parts.filter(pa.array(simple))), pc.binary_length(core).to_numpy()[simple].tolist()
        marks = pa.array([text[n:] for text, n in zip(texts, lengths, strict=True)], pa.binary()).dictionary_encode()
        kinds = [m.decode() for m in marks.dictionary.to_pylist()]
        found = self.words.get([w.decode() for w in _listed(words.dictionary)])
        other = self.parts.get(_listed(parts.filter(pa.array(~simple))))
        first, last = np.empty(len(parts), np.int64), np.zeros(len(parts), np.int64)
        first[simple], last[simple] = words.indices.to_numpy(), marks.indices.to_numpy() + 1
        first[~simple] = len(found) + np.arange(len(other))
        starts, ends = (pa.array(ids, pa.large_binary()) for ids in (found + other, [b"", *self._whole(kinds)]))
        nothing = pa.scalar(b"", pa.large_binary())
        return pc.binary_join_element_wise(starts.take(pa.array(first)), ends.take(pa.array(last)), nothing)

    def encode_all(self, texts: list[bytes | None]) -> list[bytes]:
        if not self.in_parts:
            return self._whole([(t or b"").decode("utf-8", "replace") for t in texts])
        if not texts:
            return []
        given = pa.array([t or b"" for t in texts], pa.binary())
        cut = pc.ascii_split_whitespace(given.cast(options=pc.CastOptions(pa.string(), allow_invalid_utf8=True)))
        parts = cut.values.dictionary_encode()
        ids = self._of_distinct(parts.dictionary).take(parts.indices)
        data = memoryview(ids.buffers()[2] or b"")
        ends = np.frombuffer(ids.buffers()[1], np.int64)[cut.offsets.to_numpy()].tolist()
        return [bytes(data[start:end]) for start, end in zip(ends, ends[1:], strict=False)]


def _listed(parts: pa.StringArray) -> list[bytes]:
    """The values of an array without nulls and spaces; one join and one split take less than a step for each."""
    whole = pa.LargeListArray.from_arrays([0, len(parts)], parts.cast(pa.binary()))
    return pc.binary_join(whole, b" ")[0].as_py().split(b" ") if len(parts) else []


def pieces(
    docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, end_id: int, keep_ids: bool, cached: int
) -> DataFrame:
    """The pieces of all documents, numbered within their task and length (part, length, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept((path, cached), lambda: WordIds(path, cached), slot="words")
        part, places, end = TaskContext.get().partitionId(), {}, np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, 1):
            rows: list[list] = [[] for _ in range(7 + keep_ids)]
            found = words.encode_all(raw(batch.column(1)).to_pylist())
            for doc, ids in zip(batch.column(0).to_pylist(), found, strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    length = len(piece) // 4
                    place = places[length] = places.get(length, -1) + 1
                    row = (doc, start, length, zlib.crc32(piece), total, part, place, piece)
                    for column, value in zip(rows, row, strict=False):
                        column.append(value)
            columns = [pa.array(c, pa.int64()) for c in rows[:7]]
            if keep_ids:
                columns.append(pa.array(rows[7], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "place", *["ids"] * keep_ids]
    fields = ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(ready(rows).mapInArrow(run, fields), "pieces")


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that hold every length as often as the histogram has it.

    Longest first, a length goes to the packs with the most space, one to each; what no pack has space
    for opens new ones. A length splits at most one group of equal packs and opens at most two, so
    there are at most three patterns for each length, however many pieces there are.
    """
    by_space: dict[int, list[Pattern]] = {}

    def put(space: int, packs: int, content: list[tuple[int, int]]) -> None:
        if packs:
            by_space.setdefault(space, []).append((packs, content))

    def more(content: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
        if content and content[-1][0] == length:
            return [*content[:-1], (length, content[-1][1] + 1)]
        return [*content, (length, 1)]

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for space in range(capacity, length - 1, -1):
            if not left:
                break
            for packs, content in by_space.pop(space, []):
                now = min(packs, left)
                put(space - length, now, more(content, length))
                put(space, packs - now, content)
                left -= now
        times = capacity // length
        put(capacity - times * length, left // times, [(length, times)])
        put(capacity - left % times * length, int(left % times > 0), [(length, left % times)])
    return [p for space in sorted(by_space) for p in by_space[space]]


class Places:
    """Where the n-th piece of a length goes: runs of numbers, each with its first sequence and offset."""

    def __init__(self, patterns: list[Pattern]):
        used: dict[int, int] = {}
        rows, first = [], 0
        for packs, content in patterns:
            offset = 0
            for length, times in content:
                rows.append((length, used.get(length, 0), first, times, offset))
                used[length] = used.get(length, 0) + packs * times
                offset += length * times
            first += packs
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.length, self.start, self.first, self.times, self.offset = table.T
        self.key = self.length << 48 | self.start

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the given pieces."""
        run = np.searchsorted(self.key, length << 48 | number, "right") - 1
        within = number - self.start[run]
        return self.first[run] + within // self.times[run], self.offset[run] + within % self.times[run] * length


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    end_id: int = END_ID, keep_ids: bool = False, cached_words: int = CACHED_WORDS,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): where every piece lies.

    A row's ids are its text's by the tokenizer at ``path``, then ``end_id``; a null or empty text has
    the end alone. Rows that repeat an id are packed each, null ids stay null, no rows give no rows.
    ``ids`` (with ``keep_ids``) holds little-endian unsigned 32-bit integers. ``cached_words`` bounds a
    worker's caches, which trade memory for time.
    """
    cut = pieces(docs, path, id_col, text_col, capacity, end_id, keep_ids, cached_words)
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # At most one row for each length up to the capacity.
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(shortest_pack_first(histogram, capacity))
    numbered = cut.join(first, ["part", "length"]).withColumn("number", F.col("first") + F.col("place"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(n).to_numpy() for n in ("length", "number"))
            found = [pa.array(a) for a in places.find(length, number)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), *found], [*columns, "sequence_id", "offset"]
            )

    fields = ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in [*columns, "sequence_id", "offset"])
    return numbered.select(*columns, "number").mapInArrow(run, fields)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the sequences of a ``pack`` with ids, without padding."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))  # a sequence's pieces: capacity at most
    return (
        packed.groupBy("sequence_id")
        .agg(parts.alias("parts"))
        .select(
            "sequence_id",
            F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p.length).alias("length"),
            F.aggregate("parts", F.lit(b""), lambda b, p: F.concat(b, p.ids)).alias("ids"),
        )
    )
