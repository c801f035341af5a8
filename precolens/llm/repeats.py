"""Substring dedup by repeated-phrase automata.

A window is a run of ``window`` words. A word goes if a window over it also starts in a document with
a smaller id. Texts are packed once into batches of bounded size, and then

1. every window names its anchor, the smallest hash of the phrases of ``PHRASE`` words in it. Equal
   windows have equal anchors, of which there are five times fewer; a batch lists each anchor once;
2. anchors that several documents share are sent back to the batches that have them, and those list
   their windows with such anchors, each once, with the smallest id that has it;
3. where equal windows meet, recurring passages are confirmed: a batch learns which of its windows
   start in an earlier document elsewhere (one bit each);
4. each batch joins its confirmed windows to passages, compiles those into Aho-Corasick automata of
   bounded size and streams its documents through them, which finds every occurrence.

Whatever meets in a shuffle meets once per batch, not once per document, so that a passage in a third
of all documents weighs no more than others. Across batches windows are equal if 64 + 32 bits are, two
rolling hashes over one 64-bit hash of each word; within a batch the automata match words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from precolens.llm.common import free_name, raw, ready, slices, stored

WINDOW, PHRASE = 13, 5
# Text bytes of a batch (a longer document is a batch of its own), windows of a passage and words of an
# automaton's passages; longer passages are cut, and what is left goes to further automata.
BATCH_BYTES, PASSAGE_WINDOWS, AUTOMATON_WORDS = 2 << 20, 64, 1 << 20
# Words that one shard compares, about; there are SHARDS at least.
SHARD_WORDS, SHARDS = 8 << 20, 1024

_BASES = tuple(np.uint64(b) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def pack_batches(docs: DataFrame, text_col: str) -> DataFrame:
    """(batch, words, data): the rows of ``docs`` as compressed Arrow streams, written once."""
    text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for n, batch in enumerate(slices(batches, text, BATCH_BYTES)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=options) as stream:
                stream.write_batch(batch)
            words = sum(len((t or b"").split()) for t in raw(batch.column(text)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([first | n]), pa.array([words]), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                ["batch", "words", "data"],
            )

    # Small row groups, since a row is large.
    rows = ready(docs).mapInArrow(run, "batch long, words long, data binary")
    return stored(rows, "batches", **{"parquet.block.size": str(16 << 20)})


def _unpacked(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.py_buffer(data)) as stream:
        return stream.read_next_batch()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _SPREAD
    return x ^ (x >> np.uint64(29))


class Windows:
    """The words of a batch and its windows, in order of place."""

    def __init__(self, rows: pa.RecordBatch, id_col: int, text_col: int, size: int):
        ids = rows.column(id_col).to_pylist()
        self.words = [(t or b"").split() for t in raw(rows.column(text_col)).to_pylist()]
        lengths = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.size, n = size, int(self.starts[-1])
        known: dict[bytes, int] = {}
        self.ids = np.fromiter((known.setdefault(w, len(known)) for words in self.words for w in words), np.int64, n)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
        self.hashes = hashes[self.ids]
        # Windows inside one document that has an id.
        self.doc_ids = [None if i is None else int(i) for i in ids]
        room = np.where([i is None for i in ids], 0, np.maximum(lengths - size + 1, 0)).astype(np.int64)
        owner = np.repeat(np.arange(len(room)), room)
        first = np.concatenate([[0], np.cumsum(room)])[:-1]
        self.place = np.arange(int(room.sum())) + np.repeat(self.starts[:-1] - first, room)
        self.doc = np.array([i or 0 for i in self.doc_ids], np.int64)[owner]
        self.anchor = self._anchors()

    def _rolled(self, n: int, base: np.uint64) -> np.ndarray:
        """A hash of the ``n`` words from every place on at which there are as many."""
        length = max(len(self.hashes) - n + 1, 0)
        out = np.zeros(length, np.uint64)
        for j in range(n):
            out = out * base + self.hashes[j : j + length]
        return out

    def _anchors(self) -> np.ndarray:
        low = _mixed(self._rolled(PHRASE, _BASES[0]))
        width, span = 1, self.size - PHRASE + 1
        while width < span:  # the smallest of the next ``width``
            step = min(width, span - width)
            low = np.minimum(low[: len(low) - step], low[step:]) if len(low) > step else low[:0]
            width += step
        return low[self.place]

    def listed(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct windows among the chosen ones: key, second key and least id; for each chosen window
        which of them it is."""
        at = np.flatnonzero(chosen)
        place = self.place[at]
        key = _mixed(self._rolled(self.size, _BASES[1])[place])
        second = (self._rolled(self.size, _BASES[2])[place] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((second, key))
        key, second, doc = key[order], second[order], self.doc[at][order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (second[1:] != second[:-1])])[: len(key)]
        cut, which = np.flatnonzero(new), np.empty(len(at), np.int64)
        which[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(doc, cut) if len(cut) else doc
        return key[cut], second[cut], least, which


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys * _SPREAD) >> np.uint64(33)) % np.uint64(shards)


def _by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of its keys), the keys in their order."""
    shard = _shard(keys, shards)
    order = np.argsort(shard, kind="stable")
    if len(order):
        cut = np.flatnonzero(np.diff(shard[order])) + 1
        for part in np.split(order, cut):
            yield int(shard[part[0]]), part


def _batch_of(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


class Shape(NamedTuple):
    """Where a batch's rows have id and text, the size of a window and the number of shards."""

    id_col: int
    text_col: int
    size: int
    shards: int

    def windows(self, data: bytes) -> Windows:
        return Windows(_unpacked(data), self.id_col, self.text_col, self.size)


def _list_anchors(packed: DataFrame, shape: Shape) -> DataFrame:
    """(shard, batch, keys, several): every anchor of a batch once; several: two of its documents have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for batch, data in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                w = shape.windows(data)
                order = np.argsort(w.anchor, kind="stable")
                keys, cut = np.unique(w.anchor[order], return_index=True)
                doc = w.doc[order]
                several = np.zeros(0, bool)
                if len(keys):
                    several = np.minimum.reduceat(doc, cut) < np.maximum.reduceat(doc, cut)
                out = [(s, batch, keys[p].tobytes(), np.packbits(several[p]).tobytes()) for s, p in _by_shard(keys, shape.shards)]
                shard, ids, found, flags = zip(*out, strict=True) if out else ((), (), (), ())
                yield _batch_of(
                    {"shard": (shard, pa.int64()), "batch": (ids, pa.int64()), "keys": (found, pa.binary()), "several": (flags, pa.binary())}
                )

    return ready(packed.select("batch", "data")).mapInArrow(run, "shard long, batch long, keys binary, several binary")


def _share_anchors(group: pa.Table) -> pa.Table:
    """(batch, keys): for each batch its anchors that several documents have."""
    lists = [np.frombuffer(b, np.uint64) for b in group["keys"].to_pylist()]
    flags = [
        np.unpackbits(np.frombuffer(b, np.uint8), count=len(k)).astype(bool)
        for b, k in zip(group["several"].to_pylist(), lists, strict=True)
    ]
    _, place, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    shared = counts > 1
    shared[place[np.concatenate(flags)]] = True
    chosen = np.split(shared[place], np.cumsum([len(k) for k in lists])[:-1])
    out = [(b, k[c].tobytes()) for b, k, c in zip(group["batch"].to_pylist(), lists, chosen, strict=True) if c.any()]
    return pa.table({"batch": pa.array([b for b, _ in out], pa.int64()), "keys": pa.array([k for _, k in out], pa.binary())})


def _chosen(w: Windows, shared: list[bytes] | None) -> np.ndarray:
    """The windows whose anchors are among the shared ones."""
    return np.isin(w.anchor, np.frombuffer(b"".join(shared or ()), np.uint64))


def _list_windows(marked: DataFrame, shape: Shape) -> DataFrame:
    """(shard, batch, keys, ids): a batch's distinct windows with shared anchors and their least ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for batch, data, shared in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
                w = shape.windows(data)
                key, second, least, _ = w.listed(_chosen(w, shared))
                out = [(s, batch, key[p].tobytes(), second[p].tobytes(), _small(least[p])) for s, p in _by_shard(key, shape.shards)]
                shard, ids, keys, more, docs = zip(*out, strict=True) if out else ((),) * 5
                yield _batch_of(
                    {
                        "shard": (shard, pa.int64()), "batch": (ids, pa.int64()), "keys": (keys, pa.binary()),
                        "more": (more, pa.binary()), "ids": (docs, pa.binary()),
                    }
                )

    return ready(marked).mapInArrow(run, "shard long, batch long, keys binary, more binary, ids binary")


def _small(ids: np.ndarray) -> bytes:
    """Ids as their least one and distances from it, in 32 bits if they fit."""
    base = ids.min()
    far = (ids - base).astype(np.uint64)
    narrow = far.max() < 1 << 32
    return np.int64(base).tobytes() + (far.astype(np.uint32) if narrow else far).tobytes()


def _ids(data: bytes, n: int) -> np.ndarray:
    far = np.frombuffer(data, np.uint32 if len(data) == 8 + 4 * n else np.uint64, offset=8)
    return np.frombuffer(data, np.int64, 1)[0] + far.astype(np.int64)


def _confirm(group: pa.Table) -> pa.Table:
    """(batch, shard, earlier): a bit for each window listed: whether it starts in an earlier document elsewhere."""
    keys = [np.frombuffer(b, np.uint64) for b in group["keys"].to_pylist()]
    more = np.concatenate([np.frombuffer(b, np.uint32) for b in group["more"].to_pylist()])
    ids = np.concatenate([_ids(b, len(k)) for b, k in zip(group["ids"].to_pylist(), keys, strict=True)])
    key = np.concatenate(keys)
    order = np.lexsort((more, key))
    new = np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(more[order]) != 0)])
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    earlier = np.zeros(len(key), bool)
    earlier[order] = least < ids[order]
    bits = [np.packbits(e).tobytes() for e in np.split(earlier, np.cumsum([len(k) for k in keys])[:-1])]
    return pa.table({"batch": group["batch"], "shard": group["shard"], "earlier": pa.array(bits, pa.binary())})


def _passages(place: np.ndarray, limit: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, limit) of the runs of consecutive windows, cut to PASSAGE_WINDOWS, in words."""
    first = np.concatenate([[True], np.diff(place) != 1])
    run_start = np.flatnonzero(first)[np.cumsum(first) - 1]
    cut = np.flatnonzero((np.arange(len(place)) - run_start) % PASSAGE_WINDOWS == 0)
    last = np.concatenate([cut[1:], [len(place)]]) - 1
    return place[cut], place[last] + size, np.maximum.reduceat(limit, cut)


def _covered(w: Windows, place: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Which words of the batch go.

    ``place`` has the confirmed windows in the documents that lose them and ``limit`` the id above which
    documents do. A passage's limit is the highest of its windows': a document beyond it loses them all.
    """
    edges = np.zeros(len(w.ids) + 1, np.int64)
    if not len(place):
        return edges[:-1] > 0
    start, end, limit = _passages(place, limit, w.size)
    shard = np.cumsum(end - start) // AUTOMATON_WORDS
    for part in np.split(np.arange(len(start)), np.flatnonzero(np.diff(shard)) + 1):
        # Words of the passages get letters of their own, all others share one. A shard has no more
        # than 2^20 words and a passage, fewer than there are code points without surrogates.
        inside = np.zeros(len(w.ids) + 1, np.int64)
        np.add.at(inside, start[part], 1)
        np.add.at(inside, end[part], -1)
        used = np.unique(w.ids[np.cumsum(inside[:-1]) > 0])
        letters = np.ones(int(w.ids.max()) + 1, np.uint32)
        code = np.arange(2, len(used) + 2, dtype=np.uint32)
        letters[used] = np.where(code < 0xD800, code, code + 0x800)
        text = letters[w.ids].astype("<u4").tobytes()
        automaton = ahocorasick.Automaton()
        for a, b, low in zip(start[part].tolist(), end[part].tolist(), limit[part].tolist(), strict=True):
            automaton.add_word(text[4 * a : 4 * b].decode("utf-32-le"), (b - a, low))
        automaton.make_automaton()
        starts: list[int] = []
        ends: list[int] = []
        for d, doc in enumerate(w.doc_ids):
            a, b = int(w.starts[d]), int(w.starts[d + 1])
            if doc is not None and b - a >= w.size:
                for at, (length, low) in automaton.iter(text[4 * a : 4 * b].decode("utf-32-le")):
                    if doc > low:
                        ends.append(a + at + 1)
                        starts.append(a + at + 1 - length)
        edges += np.bincount(np.array(starts, np.int64), minlength=len(edges))
        edges -= np.bincount(np.array(ends, np.int64), minlength=len(edges))
    return np.cumsum(edges[:-1]) > 0


def _locate(confirmed: DataFrame, schema: StructType, shape: Shape, name: str) -> DataFrame:
    """The rows of all batches with a struct of n_words, n_removed and the kept words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
        for rows in batches:
            for data, shared, bits in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
                table = _unpacked(data)
                w = Windows(table, shape.id_col, shape.text_col, shape.size)
                gone = np.zeros(len(w.ids), bool)
                if shared:
                    chosen = _chosen(w, shared)
                    key, _, least, which = w.listed(chosen)
                    earlier = np.zeros(len(key), bool)
                    masks = {r["shard"]: r["earlier"] for r in bits or ()}
                    for shard, p in _by_shard(key, shape.shards):
                        earlier[p] = np.unpackbits(np.frombuffer(masks[shard], np.uint8), count=len(p))
                    limit = np.where(earlier, np.iinfo(np.int64).min, least)[which]
                    goes = w.doc[chosen] > limit
                    gone = _covered(w, w.place[chosen][goes], limit[goes])
                kept, removed = [], []
                for d, words in enumerate(w.words):
                    out = gone[w.starts[d] : w.starts[d + 1]]
                    removed.append(int(out.sum()))
                    left = [x for x, o in zip(words, out.tolist(), strict=True) if not o] if removed[-1] else words
                    kept.append(b" ".join(left).decode("utf-8", "replace"))
                found = [pa.array([len(x) for x in w.words], pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
                struct = pa.StructArray.from_arrays(found, fields=list(kind))
                yield pa.RecordBatch.from_arrays([*table.columns, struct], [*table.schema.names, name])

    out = StructType([*schema.fields, StructField(name, StructType.fromDDL("n_words long, n_removed long, kept string"))])
    return ready(confirmed).mapInArrow(run, out)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, out: str = "repeats"
) -> DataFrame:
    """``docs`` and a struct ``out``: n_words, n_removed and the kept words joined by single spaces.

    Words are cut at ASCII white space and compared as they are. A word is removed if one of the
    windows of ``window`` words over it, inside its own document, also starts in a document with a
    smaller id; all windows are judged on the given texts. Null and empty texts have no words. Rows
    that share an id are no earlier than each other; rows without an id lose nothing and take nothing
    from others. Rows and other columns stay; the struct's name is lengthened if ``docs`` has it. The
    id must be an integer.
    """
    if window < PHRASE:
        raise ValueError(f"a window has {PHRASE} words at least")
    packed = pack_batches(docs, text_col)
    total = packed.agg(F.sum("words")).first()[0] or 0
    columns = docs.columns
    shape = Shape(columns.index(id_col), columns.index(text_col), window, max(SHARDS, -(-total // SHARD_WORDS)))
    anchors = _list_anchors(packed, shape)
    shared = anchors.groupBy("shard").applyInArrow(_share_anchors, "batch long, keys binary")
    shared = stored(shared.groupBy("batch").agg(F.collect_list("keys").alias("shared")), "anchors")
    marked = packed.select("batch", "data").join(shared, "batch")
    windows = _list_windows(marked, shape)
    earlier = windows.groupBy("shard").applyInArrow(_confirm, "batch long, shard long, earlier binary")
    # At most one bit for each window of a batch.
    earlier = earlier.groupBy("batch").agg(F.collect_list(F.struct("shard", "earlier")).alias("bits"))
    confirmed = packed.select("batch", "data").join(shared, "batch", "left").join(earlier, "batch", "left")
    return _locate(confirmed.select("data", "shared", "bits"), docs.schema, shape, free_name(docs, out))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with texts cut down to their kept words; texts that lose nothing stay as they are."""
    found = remove_repeats(docs, id_col, text_col)
    struct = found.columns[-1]
    kept = F.when(F.col(f"{struct}.n_removed") > 0, F.col(f"{struct}.kept")).otherwise(F.col(text_col))
    return found.withColumn(text_col, kept).drop(struct)
