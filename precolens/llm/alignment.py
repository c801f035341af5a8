"""Alignment of two tokenizers, with corpus-wide counts of the token pairs that overlap.

Each text is tokenised twice; the byte offsets where tokens of both end cut it into groups, and tokens
whose bytes overlap are linked. The links are counted by external spilling:

1. texts go through in batches of bounded size. A batch sorts its pair-document records side-major, by
   (B id, A id, document), deals them by a radix of the B id and spills each part as one zstd run;
2. the runs of a part and of a bounded group of batches are merged k ways by a heap, which counts
   each pair of the group once. The groups' counts are added by a shuffle on the pair, and a window
   over each B id, side-major again, yields the highest count;
3. counts and maxima return to the groups whose runs asked for them, and the runs are read once more:
   every record's contribution streams back to its document, summed per batch on the way.

No step holds more than the runs of ``GROUP`` batches in one part or the pairs of one B id, whatever
shares a token: a pair in a third of all links weighs one entry per run.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain, compress, groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precolens.llm.common import Cache, kept, ready, slices, stored, tokenizer_at

# Text bytes of a batch (a longer text is a batch of its own), parts that its records are dealt to, and
# batches whose runs are merged together, about.
BATCH_BYTES, PARTS, GROUP = 4 << 20, 16, 64
# Parts of texts of at most so many characters stay in a worker's cache, which holds so many.
LONGEST, CACHED = 48, 100_000
# Bits of a record for the document's number in its batch.
_DOC_BITS = 20
# Neither tokenizer joins anything across a space between two characters that are not white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPACE = "▁"
_COLUMNS = ("n_a", "n_b", "n_groups", "n_links")


class Aligner:
    """Both tokenizers, and the aligned parts of texts between spaces."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = tokenizer_at(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        written = self.a.get_vocab(with_added_tokens=True)
        self.size_a = max(written.values()) + 1
        if self.size_a * self.b.vocab_size() >= 1 << (64 - _DOC_BITS):
            raise ValueError("the vocabularies are too large")
        letter = _byte_of_letter()
        self.bytes_a = [b""] * self.size_a
        for token, i in written.items():
            self.bytes_a[i] = bytes(letter[c] for c in token) if all(c in letter for c in token) else token.encode()
        self.bytes_b = [self._piece(i) for i in range(self.b.vocab_size())]
        self.length_a, self.length_b = (np.array([len(x) for x in side]) for side in (self.bytes_a, self.bytes_b))
        # Ids as they stand within a group, at the end of its A ids, and at its end.
        ids = [range(self.size_a)] * 2 + [range(len(self.bytes_b))] * 2
        self.written = [f"{i}{mark}" for side, mark in zip(ids, ",|,;", strict=True) for i in side]
        # Spaces are only ever the start of a piece, so that pieces don't join across one.
        self.cut = not any(_SPACE in self.b.id_to_piece(i).lstrip(_SPACE) for i in range(self.b.vocab_size()))
        self.cache = Cache(self._aligned, CACHED)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(_SPACE, " ").encode()

    def _aligned(self, parts: list[str]) -> list[tuple]:
        """For each part, after a space: (groups as text, n_a, n_b, n_groups, pairs); () if the bytes differ."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
        b = self.b.encode(parts, num_threads=1)
        same = [True] * len(parts)
        if not self._gives_back(chain.from_iterable(a), chain.from_iterable(b), " " + " ".join(parts)):
            same = [self._gives_back(x, y, " " + p) for x, y, p in zip(a, b, parts, strict=True)]
        found = iter(self._grouped(list(compress(a, same)), list(compress(b, same))))
        return [next(found) if s else () for s in same]

    def _gives_back(self, a: Iterable[int], b: Iterable[int], text: str) -> bool:
        whole = text.encode()
        return b"".join(map(self.bytes_a.__getitem__, a)) == b"".join(map(self.bytes_b.__getitem__, b)) == whole

    def _grouped(self, a: list[list[int]], b: list[list[int]]) -> list[tuple]:
        """The parts' groups and pairs, all parts in one line of bytes.

        Between two neighbouring ends of tokens of either kind lies the overlap of one pair, and of no other.
        """
        if not a:
            return []
        n_a, n_b = (np.array([len(x) for x in side]) for side in (a, b))
        a, b = (np.fromiter(chain.from_iterable(side), np.int64, int(n.sum())) for side, n in ((a, n_a), (b, n_b)))
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        ends = np.union1d(ends_a, ends_b)
        pairs = (b[np.searchsorted(ends_b, ends)] * self.size_a + a[np.searchsorted(ends_a, ends)]).astype(np.uint64)
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (group_a, group_b))
        size_b = len(self.bytes_b)
        token = np.concatenate([a + self.size_a * last_a, 2 * self.size_a + b + size_b * last_b])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        written = list(map(self.written.__getitem__, token[order].tolist()))
        stop = ends_a[np.cumsum(n_a) - 1]
        of_groups, of_pairs = (np.searchsorted(x, stop, "right") for x in (cuts, ends))
        groups, data, tokens, at, from_pair = np.diff(of_groups, prepend=0), pairs.tobytes(), np.cumsum(n_a + n_b), 0, 0
        out = []
        for x, y, g, upto, pair in zip(n_a.tolist(), n_b.tolist(), groups.tolist(), tokens.tolist(), (8 * of_pairs).tolist(), strict=True):
            out.append(("".join(written[at:upto]), x, y, g, data[from_pair:pair]))
            at, from_pair = upto, pair
        return out

    def documents(self, texts: list[str | None]) -> Iterator[list[tuple]]:
        """Each text's aligned parts in order; none for a text without tokens."""
        cut = [(_CUT.split(t) if self.cut else [t]) if t else [] for t in texts]
        flat = [p for parts in cut for p in parts]
        short = iter(self.cache.get([p for p in flat if len(p) <= LONGEST]))
        long = iter(self._aligned([p for p in flat if len(p) > LONGEST]))
        for parts in cut:
            found = [next(short) if len(p) <= LONGEST else next(long) for p in parts]
            yield found if all(found) else []


def _byte_of_letter() -> dict[str, int]:
    """How byte-level models write bytes: printable ones as themselves, others from 256 on, in order."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printed)]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(rest)}


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0 on, each in as few bytes as its largest needs, compressed."""
    out = []
    for x in arrays:
        top = int(x.max()) if len(x) else 0
        width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
        out += [len(x).to_bytes(6, "little"), bytes([width]), x.astype(f"<u{width}").tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def _unpacked(data: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(data):
        n, width = int.from_bytes(data[at : at + 6], "little"), data[at + 6]
        out.append(np.frombuffer(data, f"<u{width}", n, at + 7).astype(np.int64))
        at += 7 + n * width
    return out


def _runs(pairs: np.ndarray, docs: np.ndarray, size_a: int) -> Iterator[tuple[int, bytes]]:
    """(part, run): a batch's records by part, sorted side-major. A run holds the steps between its pairs, each
    pair's number of documents, and for each of those its number and how often it has the pair."""
    records, times = np.unique(pairs << np.uint64(_DOC_BITS) | docs.astype(np.uint64), return_counts=True)
    pair = (records >> np.uint64(_DOC_BITS)).astype(np.int64)
    doc = (records & np.uint64((1 << _DOC_BITS) - 1)).astype(np.int64)
    radix = pair // size_a % PARTS
    for part in np.unique(radix).tolist():
        here = np.flatnonzero(radix == part)
        keys, first = np.unique(pair[here], return_index=True)
        held = np.diff(np.append(first, len(here)))
        yield part, _packed(np.diff(keys, prepend=0), held, doc[here], times[here])


def _spilled(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(batch, part, docs, run): of every batch its documents' own figures once, and its runs."""
    names = ["batch", "part", "docs", "run"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept((path_a, path_b), lambda: Aligner(path_a, path_b), slot="aligner")
        first = TaskContext.get().partitionId() << 32
        whole = (b.slice(at, 1 << _DOC_BITS) for b in batches for at in range(0, max(b.num_rows, 1), 1 << _DOC_BITS))
        for n, batch in enumerate(slices(whole, 1, BATCH_BYTES)):
            figures, pairs = [], []
            for found in aligner.documents(batch.column(1).to_pylist()):
                if not found:
                    figures.append((0, 0, 0, 0, ""))
                    pairs.append(b"")
                    continue
                texts, a, b, groups, linked = zip(*found, strict=True)
                pairs.append(b"".join(linked))
                figures.append((sum(a), sum(b), sum(groups), len(pairs[-1]) // 8, hashlib.sha256("".join(texts)[:-1].encode()).hexdigest()))
            columns = [pa.array(c) for c in zip(*figures, strict=True)]
            own = pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *_COLUMNS, "groups_sha256"])
            owner = np.repeat(np.arange(len(pairs)), [len(p) // 8 for p in pairs])
            rows = [(-1, _stream(own), None)]
            rows += [(p, None, data) for p, data in _runs(np.frombuffer(b"".join(pairs), np.uint64), owner, aligner.size_a)]
            part, of_docs, runs = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([first | n] * len(rows), pa.int64()), pa.array(part, pa.int64()), pa.array(of_docs, pa.binary()), pa.array(runs, pa.binary())],
                names,
            )

    rows = ready(docs).mapInArrow(run, "batch long, part long, docs binary, run binary")
    # Small row groups, since a row is large.
    return stored(rows, "runs", **{"parquet.block.size": str(16 << 20)})


def _stream(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def merged(runs: Iterable[bytes]) -> Iterator[tuple[int, int]]:
    """(pair, links) of the runs' pairs, merged side-major by a heap."""

    def entries(data: bytes) -> Iterator[tuple[int, int]]:
        steps, held, _, times = _unpacked(data)
        links = np.add.reduceat(times, np.cumsum(held) - held)
        return zip(np.cumsum(steps).tolist(), links.tolist(), strict=True)

    for pair, same in groupby(heapq.merge(*map(entries, runs)), key=lambda e: e[0]):
        yield pair, sum(n for _, n in same)


def _counted(runs: DataFrame) -> DataFrame:
    """(part, salt, pair, n): how many links of a group of batches hold a pair."""
    names = ["part", "salt", "pair", "n"]

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        found = list(merged(r for r in rows.column("run").to_pylist()))
        columns = np.array(found, np.int64).reshape(-1, 2).T
        keys = [pa.array([k.as_py()] * len(found), pa.int64()) for k in key]
        return pa.Table.from_arrays([*keys, *(pa.array(c) for c in columns)], names)

    rows = runs.groupBy("part", "salt").applyInArrow(run, ", ".join(f"{n} long" for n in names))
    return stored(rows, "pairs", compression="zstd")


def pair_counts(counted: DataFrame, size_a: int) -> DataFrame:
    """(pair, total, best): each pair's links in all documents, and whether no pair of its B id has more."""
    totals = counted.groupBy("pair").agg(F.sum("n").alias("total"))
    # A B id has no more pairs than there are A ids.
    highest = F.max("total").over(Window.partitionBy(F.expr(f"pair div {size_a}")))
    return totals.select("pair", "total", (F.col("total") == highest).alias("best"))


def _contributions(runs: DataFrame, replies: DataFrame) -> DataFrame:
    """(batch, data): what a run's records give to the batch's documents: their numbers, n_best and count_sum."""

    def run(key: tuple, rows: pa.Table, found: pa.Table) -> pa.Table:
        pair, total, best = (found.column(c).to_numpy() for c in ("pair", "total", "best"))
        order = np.argsort(pair)
        pair, total, best = pair[order], total[order], best[order].astype(np.int64)
        out = []
        for data in rows.column("run").to_pylist():
            steps, held, doc, times = _unpacked(data)
            at = np.repeat(np.searchsorted(pair, np.cumsum(steps)), held)
            sums = np.zeros((2, int(doc.max()) + 1), np.int64)
            np.add.at(sums[0], doc, times * best[at])
            np.add.at(sums[1], doc, times * total[at])
            there = np.flatnonzero(sums[1])
            out.append(_packed(there, sums[0, there], sums[1, there]))
        return pa.Table.from_arrays([rows.column("batch"), pa.array(out, pa.binary())], ["batch", "data"])

    keys = ["part", "salt"]
    return runs.groupBy(*keys).cogroup(replies.groupBy(*keys)).applyInArrow(run, "batch long, data binary")


def _collected(own: DataFrame, parts: DataFrame) -> DataFrame:
    """The documents' rows: their own figures and the sums of what the parts give."""
    rows = own.select("batch", "docs", F.lit(None).cast("binary").alias("data"))
    rows = rows.unionByName(parts.select("batch", F.lit(None).cast("binary").alias("docs"), "data"))

    def run(rows: pa.Table) -> pa.Table:
        with pa.ipc.open_stream(next(d for d in rows.column("docs").to_pylist() if d is not None)) as stream:
            docs = stream.read_next_batch()
        sums = np.zeros((2, docs.num_rows), np.int64)
        for data in rows.column("data").to_pylist():
            if data is not None:
                there, best, count = _unpacked(data)
                sums[0, there] += best
                sums[1, there] += count
        columns = {n: docs.column(n) for n in docs.schema.names} | {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
        return pa.table({n: columns[n] for n in names})

    names = ["doc_id", *_COLUMNS, "n_best", "count_sum", "groups_sha256"]
    fields = ", ".join(f"{n} {'string' if n == 'groups_sha256' else 'long'}" for n in names)
    return rows.groupBy("batch").applyInArrow(run, fields)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``.

    ``path_a`` is a byte-level tokenizer's file, which gets each text after a space, ``path_b`` a
    sentencepiece model that adds one itself; special tokens' strings are plain text. ``n_best`` counts the links
    whose pair is its B id's most frequent one in all documents, ties included; ``count_sum`` adds up the pairs'
    counts over the links. The digest is of the groups in order, A ids and B ids in decimal:
    ``a1,a2|b1;a3|b2,b3``. A text that is null, empty or not given back by both tokenizers has no tokens:
    zeros and an empty digest. Rows that repeat an id are counted each, null ids stay null, no rows give
    no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spilled = _spilled(rows, path_a, path_b)
    own = spilled.where("docs is not null").select("batch", "docs")
    groups = max(1, -(-own.select("batch").count() // GROUP))
    salt = F.pmod(F.xxhash64("batch"), F.lit(groups)).alias("salt")
    runs = spilled.where("run is not null").select("batch", "part", salt, "run")
    counted = _counted(runs)
    replies = counted.select("part", "salt", "pair").join(pair_counts(counted, Aligner(path_a, path_b).size_a), "pair")
    return _collected(own, _contributions(runs, replies))
