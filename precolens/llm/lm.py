"""Language-model scoring with a weighted backoff automaton.

The model is a trigram model of words, smoothed by absolute discounting: the discount of every n-gram of
the training texts goes to its context's shorter suffix, down to a smoothed unigram distribution of all
words. As an automaton, contexts are states, n-grams are arcs that carry their whole smoothed probability,
and a state's failure arc to its suffix weighs what its discounts add up to, so that the probabilities in
each state add up to one. Every n-gram counts, at any size of the corpus.

The automaton of a large corpus fits no worker, but a batch of texts needs a part of it only:

1. texts become batches of numbered words, written once;
2. a batch lists its distinct trigrams, each once, with how often its training texts have them, in the
   shards of their contexts;
3. a shard adds up the lists and answers each in its own order: counts of its trigrams and contexts;
4. a batch compiles the automaton of its own n-grams from the answers and walks through its texts from
   left to right, carrying the state and adding up log-probabilities.

Words with at least ``WORD_SHARE`` of the training tokens have numbers, which are sent to workers; there are
2^20 at most. All others are named by 62 bits of a hash. Contexts in many trigrams are
spread over shards; their totals, 2^14 at most, are sent, too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precolens.llm.common import raw, ready, slices, stored

# Least share of the training tokens of words that get a number.
WORD_SHARE = 2.0**-20
# Bytes of a word that is sent as such; longer ones are sent as their hash.
LONGEST = 128
ADDED, DISCOUNT = 0.1, 0.5
# Entries that a task counts before it hands them on; bytes of text that are cut into words at once.
COUNTED, CUT_BYTES = 500_000, 4 << 20
# Tokens of a run, of which a batch has many that are walked through side by side.
RUN_TOKENS = 256
END = ""  # stands for the end of a text in the counts of words
# Before a text, at its end, after that; numbers of words follow.
START, STOP, AFTER, FIRST = 0, 1, 2, 3
_HASHED = 1 << 62  # from here on names are hashes
_PLACES = 1 << 21  # above all numbers; from here on places in a list of hashes
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_SPREAD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


class Sizes(NamedTuple):
    """Bounds on what is worked on at once; they change no result.

    ``hot_share`` of all trigrams makes a context spread over shards. Tokens of a batch and of a
    piece of a long text, and the listed trigrams of a shard, are about as many; there are ``shards`` at least.
    """

    hot_share: float = 2.0**-14
    batch_tokens: int = 1 << 18
    piece_tokens: int = 1 << 17
    shard_grams: int = 1 << 20
    shards: int = 64


def held_out(id_col: Column) -> Column:
    """Whether the crc32 of the id's text is divisible by 10; a null id counts as empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def tokens(text: bytes | None) -> Iterator[list[bytes]]:
    """The words in order, A-Z lowered, in lists of bounded size; the end is not among them."""
    text, at = text or b"", 0
    while len(text) - at > CUT_BYTES and (space := _SPACE.search(text, at + CUT_BYTES)):
        yield text[at : space.start()].lower().split()
        at = space.start()
    yield text[at:].lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over the texts in the first column, ``END`` for each text's end; written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = pa.array([w.decode("utf-8", "replace") for w in seen], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in slices(batches, 0):
            for text in raw(batch.column(0)).to_pylist():
                for words in tokens(text):
                    seen.update(words)
            seen[END.encode()] += batch.num_rows
            if len(seen) > COUNTED:
                yield flush()
                seen.clear()
        yield flush()

    found = ready(texts).mapInArrow(run, "word string, n long").where("n > 0")
    return stored(found.groupBy("word").agg(F.sum("n").alias("n")), "words")


class Vocabulary(NamedTuple):
    """The frequent words, most frequent first, as bytes or, if long, as the hash that names them; their
    counts; the number of texts, tokens and distinct words."""

    words: list[bytes | int]
    counts: np.ndarray
    texts: int
    tokens: int
    distinct: int

    @property
    def smoothing(self) -> float:
        return self.tokens + ADDED * (self.distinct + 1)

    def numbers(self) -> dict[bytes | int, int]:
        return {w: FIRST + i for i, w in enumerate(self.words)}


def vocabulary(counts: DataFrame, share: float = WORD_SHARE) -> Vocabulary:
    total, distinct, texts = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("n"))), F.lit(0))
    ).first()
    # No more than 1 / share words can have it.
    often = counts.where((F.col("n") >= share * total) & (F.col("word") != END))
    short = F.when(F.octet_length("word") <= LONGEST, F.col("word"))
    found = often.select("n", F.xxhash64("word").alias("hash"), short.alias("word")).toArrow().to_pylist()
    found.sort(key=lambda r: (-r["n"], r["hash"]))
    words = [_name(r["hash"] % 2**64) if r["word"] is None else r["word"].encode() for r in found]
    return Vocabulary(words, np.array([r["n"] for r in found], np.int64), texts, total, distinct)


def _name(hashed: int) -> int:
    return hashed >> 2 | _HASHED


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays without negative numbers, in as few bytes each as their largest number needs, compressed byte by byte."""
    out = [np.uint8(len(arrays)).tobytes()]
    for x in arrays:
        high = int(x.max()) if len(x) else 0
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if high <= np.iinfo(k).max)
        size = np.dtype(kind).itemsize
        out += [np.array([size, len(x)], np.int64).tobytes(), x.astype(kind).view(np.uint8).reshape(-1, size).T.tobytes()]
    return zstandard.compress(b"".join(out), 1)


def _arrays(data: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(data)
    out, at = [], 1
    for _ in range(data[0]):
        size, n = np.frombuffer(data, np.int64, 2, at).tolist()
        at += 16
        planes = np.frombuffer(data, np.uint8, size * n, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{size}").ravel().astype(np.uint64))
        at += size * n
    return out


def _short(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names with hashes replaced by their places in the list of distinct ones, which comes second."""
    rare = names >= _HASHED
    hashes, place = np.unique(names[rare], return_inverse=True)
    out = names.copy()
    out[rare] = place.astype(np.uint64) + np.uint64(_PLACES)
    return out, hashes


def _named(short: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = short.copy()
    rare = short >= _PLACES
    out[rare] = hashes[(short[rare] - np.uint64(_PLACES)).astype(np.int64)]
    return out


_PIECES = pa.list_(
    pa.struct([("row", pa.int64()), ("doc", pa.int64()), ("held", pa.bool_()), ("learn", pa.bool_()), ("size", pa.int64()), ("own", pa.int64()), ("last", pa.bool_())])
)
_BATCHES = (
    "batch long, grams long, data binary, often binary, pieces array<struct<row: bigint, doc: bigint, "
    "held: boolean, learn: boolean, size: bigint, own: bigint, last: boolean>>"
)


def _often(names: np.ndarray, line: np.ndarray, least: float) -> bytes:
    """The pairs of numbered words that follow each other ``least`` times in a line of places in ``names``."""
    own = (np.bincount(line, minlength=len(names)) >= least) & (names < _HASHED)
    at = np.flatnonzero(own[line[:-1]] & own[line[1:]])
    key, n = np.unique(line[at] * len(names) + line[at + 1], return_counts=True)
    key, n = key[n >= least], n[n >= least]
    return _packed(names[key // len(names)], names[key % len(names)], n)


def _batches(texts: DataFrame, words: Broadcast, sizes: Sizes) -> DataFrame:
    """Batches of the texts of (id, text, held, learn) in pieces, written once.

    ``data`` has the distinct words and their order, ``often`` the contexts with ``hot_share`` of the batch's trigrams. A
    piece has two tokens before its ``own`` and two after, where there are any, ``size`` in all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = words.value.numbers()
        get = number.get
        first = TaskContext.get().partitionId() << 40
        row = batch_no = 0
        lines, pieces, gathered = [], [], 0

        def name(word: bytes) -> int:
            code = _name(xxhash.xxh64_intdigest(word, 42))
            return get(code, code) if len(word) > LONGEST else code

        def flush() -> pa.RecordBatch:
            nonlocal batch_no, gathered
            batch_no += 1
            names, line = np.unique(np.concatenate(lines), return_inverse=True)
            data = _packed(line, *_short(names))
            grams = len(line) - 2 * len(pieces)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([first | batch_no]), pa.array([grams]), pa.array([data], pa.binary()),
                    pa.array([_often(names, line, sizes.hot_share * grams)], pa.binary()), pa.array([pieces], _PIECES),
                ],
                ["batch", "grams", "data", "often", "pieces"],
            )
            lines.clear()
            pieces.clear()
            gathered = 0
            return out

        for batch in slices(batches, 1):
            facts = zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True)
            for (doc, held, learn), text in zip(facts, raw(batch.column(1)).to_pylist(), strict=True):
                cut = [[n if (n := get(w)) is not None else name(w) for w in some] for some in tokens(text)]
                line = np.concatenate([np.array(x, np.uint64) for x in ([START, START], *cut, [STOP, AFTER])])
                row += 1
                for at in range(2, len(line), sizes.piece_tokens):
                    end = min(at + sizes.piece_tokens, len(line))
                    if end == len(line) - 1:
                        end += 1  # what comes after the end stays with it
                    elif at == len(line) - 1:
                        continue
                    piece = line[at - 2 : end + 2]
                    lines.append(piece)
                    pieces.append(
                        {"row": first | row, "doc": doc, "held": held, "learn": learn, "size": len(piece), "own": end - at, "last": end == len(line)}
                    )
                    gathered += len(piece)
                    if gathered >= sizes.batch_tokens:
                        yield flush()
        if pieces:
            yield flush()

    return stored(ready(texts).mapInArrow(run, _BATCHES), "batches", **{"parquet.block.size": str(16 << 20)})


class Grams:
    """The distinct trigrams of a batch, in order of their words.

    ``names`` are those of its words, in order; ``line`` has a word's place there for every token. Contexts
    are ``x, y``; a trigram is its ``context`` and ``z``, and its training texts have it ``n`` times.
    """

    def __init__(self, data: bytes, pieces: list[dict]):
        line, short, hashes = _arrays(data)
        self.names, self.line = _named(short, hashes), line.astype(np.int64)
        line, width = self.line, len(self.names)
        sizes = np.array([p["size"] for p in pieces], np.int64)
        self.ends = np.cumsum(sizes)
        # A trigram belongs to its last token, which counts if the piece owns it.
        place = np.arange(len(line)) - np.repeat(self.ends - sizes, sizes)
        own = np.repeat([p["own"] for p in pieces], sizes)
        learn = np.repeat([p["learn"] for p in pieces], sizes)
        at = np.flatnonzero(place >= 2)
        counted = learn[at] & (place[at] < own[at] + 2)
        key = (line[at - 2] * width + line[at - 1]) * width + line[at]
        key, which = np.unique(key, return_inverse=True)
        self.n = np.bincount(which, weights=counted, minlength=len(key)).astype(np.int64)
        pair, self.z = key // width, key % width
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        self.context = np.cumsum(new) - 1
        self.pairs = pair[new]
        self.x, self.y = self.pairs // width, self.pairs % width

    def by_shard(self, shards: int, hot: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, places of its trigrams), the trigrams in their order."""
        x, y = self.names[self.x], self.names[self.y]
        # All contexts of a word without a number are in one shard.
        mixed = x * _SPREAD[0] + np.where(x < _HASHED, y * _SPREAD[1], np.uint64(0))
        spread = np.isin(_pair_key(x, y), hot)[self.context]
        mixed = mixed[self.context] + np.where(spread, self.names[self.z] * _SPREAD[2], np.uint64(0))
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _SPREAD[2]
        shard = (mixed >> np.uint64(33)) % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            yield int(shard[part[0]]), part


def _pair_key(x: np.ndarray, y: np.ndarray, limit: int = _HASHED) -> np.ndarray:
    """One number for contexts of numbered words, which are below ``limit``, the largest one for others."""
    return np.where((x < limit) & (y < limit), x << np.uint64(32) | y, np.uint64(2**64 - 1))


def _hot(batches: DataFrame, least: float) -> np.ndarray:
    """Keys of the contexts that occur ``least`` times, counted in the batches where they are frequent."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            for often in part.column(0).to_pylist():
                x, y, n = _arrays(often)
                key = _pair_key(x, y)
                fits = key != 2**64 - 1
                yield pa.RecordBatch.from_arrays([pa.array(key[fits].astype(np.int64)), pa.array(n[fits].astype(np.int64))], ["key", "n"])

    counts = ready(batches.select("often")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= least).select("key").toArrow()["key"].to_numpy()
    return np.sort(found.astype(np.uint64))


def _list(batches: DataFrame, shards: int, hot: Broadcast) -> DataFrame:
    """(shard, batch, grams): the trigrams of a batch and their counts, each once."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            for batch, data, pieces in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                g = Grams(data, pieces)
                shard, grams = [], []
                for s, p in g.by_shard(shards, hot.value):
                    c = g.context[p]
                    short, hashes = _short(np.concatenate([g.names[g.x[c]], g.names[g.y[c]], g.names[g.z[p]]]))
                    x, y, z = np.split(short, 3)
                    shard.append(s)
                    grams.append(_packed(np.diff(x, prepend=np.uint64(0)), y, z, g.n[p], hashes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard, pa.int64()), pa.array([batch] * len(shard), pa.int64()), pa.array(grams, pa.binary())],
                    ["shard", "batch", "grams"],
                )

    return ready(batches.select("batch", "data", "pieces")).mapInArrow(run, "shard long, batch long, grams binary")


_ANSWER = "batch long, shard long, counts binary, firsts binary"


def _add_up(hot: Broadcast):
    """For each list of a shard the counts in its order, and totals that other shards have parts of."""

    def run(group: pa.Table) -> pa.Table:
        lists, hashes = [], []
        for data in group["grams"].to_pylist():
            x, y, z, n, own = _arrays(data)
            lists.append(np.stack([np.cumsum(x, dtype=np.uint64), y, z, n]).astype(np.int64))
            hashes.append(own)
        cuts = np.cumsum([some.shape[1] for some in lists])[:-1]
        x, y, z, n = np.concatenate(lists, axis=1)
        names, place = np.unique(np.concatenate(hashes), return_inverse=True)
        # Numbers below ``limit``, then the places of the shard's hashes instead of those of a list's.
        words = np.concatenate([x, y, z])
        limit = int(words[words < _PLACES].max(initial=0)) + 1
        width, at = limit + len(names), np.cumsum([0, *map(len, hashes)])
        of_list = np.repeat(at[:-1], [some.shape[1] for some in lists])
        x, y, z = (np.where(w < _PLACES, w, limit + place[np.where(w < _PLACES, 0, of_list + w - _PLACES)] if len(place) else w) for w in (x, y, z))
        del lists, words, of_list
        # One key if it fits.
        order = np.argsort((x * width + y) * width + z) if width <= 1 << 21 else np.lexsort((z, x * width + y))
        x, y, z = x[order], y[order], z[order]
        new_x = np.concatenate([[True], x[1:] != x[:-1]])
        new_pair = new_x | np.concatenate([[True], y[1:] != y[:-1]])
        new = new_pair | np.concatenate([[True], z[1:] != z[:-1]])
        gram, pair = np.flatnonzero(new), np.flatnonzero(new_pair)
        times = np.add.reduceat(n[order], gram)
        first = np.flatnonzero(new_pair[gram])
        total, kinds = np.add.reduceat(times, first), np.add.reduceat((times > 0).astype(np.int64), first)
        # Contexts that are spread over shards: their parts are added up elsewhere.
        key = _pair_key(x[pair].astype(np.uint64), y[pair].astype(np.uint64), limit)
        spread = np.isin(key, hot.value) & (total > 0)
        seen = (total > 0) & ~spread & ~((x[pair] == START) & (y[pair] == START))
        word = np.flatnonzero(new_x[pair])
        words, after = x[pair][word], np.add.reduceat(seen.astype(np.int64), word)
        numbered = (words < limit) & (after > 0)
        firsts = _packed(words[numbered], after[numbered], key[spread], total[spread], kinds[spread])
        # Words without a number have all their contexts here, hence all their occurrences.
        rare = words >= limit
        occurs, after = np.where(rare, np.add.reduceat(total, word), 0), np.where(rare, after, 0)
        in_pair, in_word = np.cumsum(new_pair) - 1, np.cumsum(new_x) - 1
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        gram_of = np.cumsum(new) - 1
        counts = []
        for at in np.split(back, cuts):
            p, w = in_pair[at], in_word[at]
            other_pair, other_word = (np.concatenate([[True], i[1:] != i[:-1]]) for i in (p, w))
            p, w = p[other_pair], w[other_word]
            counts.append(_packed(times[gram_of[at]], total[p], kinds[p], occurs[w], after[w]))
        firsts = [firsts, *[None] * (len(counts) - 1)]
        return pa.table(
            {"batch": group["batch"], "shard": group["shard"], "counts": pa.array(counts, pa.binary()), "firsts": pa.array(firsts, pa.binary())}
        )

    return run


class Totals(NamedTuple):
    """Of each number of a word how many words follow it; of the spread contexts, by key, totals and followers."""

    after: np.ndarray
    keys: np.ndarray
    total: np.ndarray
    kinds: np.ndarray


def _totals(answers: DataFrame, words: int) -> Totals:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            for firsts in part.column(0).to_pylist():
                word, after, key, total, kinds = (a.astype(np.int64) for a in _arrays(firsts))
                none = np.zeros(len(word), np.int64)
                columns = (np.repeat([False, True], [len(word), len(key)]), np.concatenate([word, key]), np.concatenate([after, kinds]), np.concatenate([none, total]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["pair", "key", "kinds", "total"])

    parts = ready(answers.where("firsts is not null").select("firsts")).mapInArrow(run, "pair boolean, key long, kinds long, total long")
    # One row for each number or spread context at most.
    found = parts.groupBy("pair", "key").agg(F.sum("kinds").alias("kinds"), F.sum("total").alias("total")).toArrow()
    pair, key, kinds, total = (found[c].to_numpy() for c in ("pair", "key", "kinds", "total"))
    pair = pair.astype(bool)
    after = np.zeros(FIRST + words, np.int64)
    after[key[~pair]] = kinds[~pair]
    spread = key[pair]
    np.add.at(after, spread[spread != 0] >> 32, 1)  # key 0 is what comes before a text, whom nothing precedes
    order = np.argsort(spread)
    return Totals(after, spread[order].astype(np.uint64), total[pair][order], kinds[pair][order])


class Automaton:
    """States, arcs with log10 weights and failure arcs of the n-grams of a batch.

    State 0 is the empty context, ``1 + w`` that of the word ``w``, then come those of two words. ``arcs``
    has ``state * width + w`` of every arc in order, and state 0 has one for every word.
    """

    def __init__(self, g: Grams, times: np.ndarray, total: np.ndarray, kinds: np.ndarray, occurs: np.ndarray, after: np.ndarray, smoothing: float):
        """``times`` of the trigrams, ``total`` and ``kinds`` of followers of their contexts, ``occurs`` and
        ``after`` of the words, all in the training texts."""
        self.g, self.width = g, len(g.names)
        width, pairs, x, y = self.width, g.pairs, g.x, g.y
        own = (occurs + ADDED) / smoothing
        known = after > 0
        fall = np.where(known, DISCOUNT * after / np.maximum(occurs, 1), 1.0)
        two = np.where(total > 0, (total - DISCOUNT) / np.maximum(occurs[x], 1), 0.0) + fall[x] * own[y]
        arc2 = np.flatnonzero((total > 0) & (g.names[y] != START))
        fall2 = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        # An arc leads to the context of its last two words, which every trigram that the batch owns has.
        to = np.searchsorted(pairs, y[g.context] * width + g.z)
        found = pairs[np.minimum(to, len(pairs) - 1)] == y[g.context] * width + g.z
        arc3 = np.flatnonzero((times > 0) & found & (g.names[g.z] != AFTER))
        c, to = g.context[arc3], to[arc3]
        three = (times[arc3] - DISCOUNT) / total[c] + fall2[c] * two[to]
        # All kinds are in order of their states and words already.
        self.arcs = np.concatenate([np.arange(width), (1 + x[arc2]) * width + y[arc2], (1 + width + c) * width + g.z[arc3]])
        self.seen, self.log_own = occurs > 0, np.log10(own)
        self.weight = np.concatenate([self.log_own, np.log10(np.concatenate([two[arc2], three]))])
        word_state = np.where(known, 1 + np.arange(width), 0)
        self.target = np.concatenate([word_state, 1 + width + arc2, 1 + width + to])
        self.backoff = np.log10(np.concatenate([[1.0], fall, fall2]))
        self.fail = np.concatenate([np.zeros(1 + width, np.int64), word_state[y]])
        self.has = total > 0

    def states(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The states of the longest suffixes of the words ``a, b`` that have one."""
        pairs, key = self.g.pairs, a * self.width + b
        i = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        return np.where((pairs[i] == key) & self.has[i], 1 + self.width + i, self.target[b])

    def walk(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The weights along the paths of the runs of ``size`` words from places ``start`` of the line on.

        All runs go on by a word at a time, side by side, each with a state of its own, first that of the two
        words before it: where an arc is missing, along failure arcs until there is one.
        """
        order = np.argsort(-size, kind="stable")
        start, size, line, arcs, width = start[order], size[order], self.g.line, self.arcs, self.width
        state, total = self.states(line[start - 2], line[start - 1]), np.zeros(len(start))
        left = len(size) - np.searchsorted(size[::-1], np.arange(size.max(initial=0)), side="right")
        for step, runs in enumerate(left.tolist()):
            run, w = np.arange(runs), line[start[:runs] + step]
            while len(run):
                at = state[run]
                key = at * width + w
                arc = np.minimum(np.searchsorted(arcs, key), len(arcs) - 1)
                hit = arcs[arc] == key
                on = run[hit]
                total[on] += self.weight[arc[hit]]
                state[on] = self.target[arc[hit]]
                run, w, at = run[~hit], w[~hit], at[~hit]
                total[run] += self.backoff[at]
                state[run] = self.fail[at]
        out = np.empty(len(total))
        out[order] = total
        return out


def _steps(ordered: np.ndarray) -> np.ndarray:
    """The distinct values of an ordered array that is not empty."""
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])]


def _compiled(g: Grams, answers: list[dict], shards: int, words: Vocabulary, totals: Totals) -> Automaton:
    """The automaton of a batch from the shards' answers to its lists."""
    times = np.zeros(len(g.z), np.int64)
    total, kinds = np.zeros(len(g.x), np.int64), np.zeros(len(g.x), np.int64)
    occurs, after = np.zeros(len(g.names), np.int64), np.zeros(len(g.names), np.int64)
    numbered = g.names < _HASHED
    number = g.names[numbered].astype(np.int64)
    occurs[numbered] = np.concatenate([[words.texts, words.texts, 0], words.counts])[number]
    after[numbered] = totals.after[number]
    counts = {a["shard"]: a["counts"] for a in answers}
    for shard, p in g.by_shard(shards, totals.keys):
        n, part_total, part_kinds, part_occurs, part_after = (a.astype(np.int64) for a in _arrays(counts[shard]))
        times[p] = n
        c = _steps(g.context[p])
        total[c], kinds[c] = part_total, part_kinds
        w = _steps(g.x[c])
        rare = ~numbered[w]
        occurs[w[rare]], after[w[rare]] = part_occurs[rare], part_after[rare]
    key = _pair_key(g.names[g.x], g.names[g.y])
    spread = np.flatnonzero(np.isin(key, totals.keys))
    at = np.searchsorted(totals.keys, key[spread])
    total[spread], kinds[spread] = totals.total[at], totals.kinds[at]
    return Automaton(g, times, total, kinds, occurs, after, words.smoothing)


_PARTS = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _walk(answered: DataFrame, shards: int, words: Broadcast, totals: Broadcast) -> DataFrame:
    """Of every piece of the batches of (data, pieces, answers) what its tokens add to its text's row."""
    names = [c.split()[0] for c in _PARTS.split(", ")]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            for data, pieces, answers in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                g = Grams(data, pieces)
                model = _compiled(g, answers, shards, words.value, totals.value)
                field = {f: np.array([p[f] for p in pieces]) for f in ("size", "own", "last")}
                own = field["own"] - field["last"]
                runs = -(-own // RUN_TOKENS)
                piece = np.repeat(np.arange(len(own)), runs)
                into = (np.arange(len(piece)) - np.repeat(np.cumsum(runs) - runs, runs)) * RUN_TOKENS
                start = (g.ends - field["size"] + 2)[piece] + into
                score = model.walk(start, np.minimum(own[piece] - into, RUN_TOKENS))
                place = np.repeat(np.arange(len(own)), own)
                line = g.line[np.arange(len(place)) + np.repeat(g.ends - field["size"] + 2 - (np.cumsum(own) - own), own)]
                add = [np.bincount(k, x, len(own)) for k, x in ((place, model.seen[line]), (place, model.log_own[line]), (piece, score))]
                given = [pa.array([p[f] for p in pieces], k) for f, k in (("row", pa.int64()), ("doc", pa.int64()), ("held", pa.bool_()))]
                columns = [*given, pa.array(own), pa.array(add[0].astype(np.int64)), pa.array(add[1]), pa.array(add[2])]
                yield pa.RecordBatch.from_arrays(columns, names)

    return ready(answered).mapInArrow(run, _PARTS)


def score(
    docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", word_share: float = WORD_SHARE, sizes: Sizes = Sizes()
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    The model learns from the rows where ``held`` is not true. ``score`` is its log10 probability of the
    text's words and its end, ``base_score`` that of the unigrams alone. Unknown words share one
    probability; a model without training rows knows no word. A null or empty text has the end alone. Rows
    that repeat an id are scored each; null ids stay null. A text longer than a piece is walked through in
    pieces, each from the state where the one before it ends. No rows give none; other columns are left out.
    """
    held = F.coalesce(held, F.lit(False))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), held.alias("held"))
    context = docs.sparkSession.sparkContext
    words = vocabulary(word_counts(texts.where("not held").select("text")), word_share)
    sent = context.broadcast(words)
    batches = _batches(texts.withColumn("learn", ~F.col("held")), sent, sizes)
    grams = batches.agg(F.coalesce(F.sum("grams"), F.lit(0))).first()[0]
    hot = context.broadcast(_hot(batches, sizes.hot_share * grams))
    shards = max(sizes.shards, -(-grams // sizes.shard_grams))
    lists = _list(batches, shards, hot)
    answers = stored(lists.groupBy("shard").applyInArrow(_add_up(hot), _ANSWER), "answers")
    totals = _totals(answers, len(words.words))
    # Spread contexts that no training text has are not among the totals, but were spread all the same.
    missing = np.setdiff1d(hot.value, totals.keys)
    keys, none = np.concatenate([totals.keys, missing]), np.zeros(len(missing), np.int64)
    order = np.argsort(keys)
    totals = Totals(totals.after, keys[order], np.concatenate([totals.total, none])[order], np.concatenate([totals.kinds, none])[order])
    given = answers.groupBy("batch").agg(F.collect_list(F.struct("shard", "counts")).alias("answers"))
    answered = batches.select("batch", "data", "pieces").join(given, "batch").select("data", "pieces", "answers")
    parts = _walk(answered, shards, sent, context.broadcast(totals))
    return parts.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        F.sum("base_score").alias("base_score"),
        F.sum("score").alias("score"),
    ).drop("row")


def train_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` of all rows by a model of those that ``held_out`` leaves."""
    return score(docs, held_out(F.col(id_col)), id_col, text_col)
