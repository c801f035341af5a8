"""Token counts by a two-tier lookup on the map side.

A first pass finds the frequent groups of pre-tokens over all documents; their token counts, taken
from the tokenizer, go to every worker as one compact table. The second pass looks every group up
there, then in the worker's cache; the tokenizer sees only what both miss. Neither texts nor
pre-tokens are shuffled, only each task's frequent groups.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precolens.llm.bpe import groups
from precolens.llm.common import Cache, free_name, kept, raw, ready, slices, tokenizer_at

# The table holds at most FREQUENT groups of at most LONGEST characters. A task proposes those with
# at least SHARE of its groups, so 1 / SHARE at most, and forgets rare ones beyond COUNTED.
FREQUENT, LONGEST, SHARE, COUNTED = 65_536, 48, 2.0**-16, 400_000
CACHED = 200_000


def frequent_groups(docs: DataFrame, pattern: str, text_col: str = "text") -> list[str]:
    """The most frequent groups of pre-tokens, by the counts of the tasks in which they are frequent.

    What is missing here is only looked up elsewhere; counts of tokens don't depend on it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen, total = regex.compile(pattern), Counter(), 0
        for batch in slices(batches, 0):
            for text in batch.column(0).to_pylist():
                if text:
                    found = groups(text, cut)
                    seen.update(found)
                    total += len(found)
            least = 1
            while len(seen) > COUNTED:
                least *= 2
                seen = Counter({g: n for g, n in seen.items() if n >= least})
        often = [(g, n) for g, n in seen.items() if n >= SHARE * total and 0 < len(g) <= LONGEST and "\0" not in g]
        yield pa.RecordBatch.from_arrays(
            [pa.array([g for g, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())], ["word", "n"]
        )

    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = ready(texts).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in rows.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]


class Counts:
    """Token counts of groups: the frequent ones from a table, others from the tokenizer or a cache."""

    def __init__(self, path: str, words: bytes, lengths: bytes):
        self.tokenizer = tokenizer_at(path)
        self.table = dict(zip(words.decode().split("\0"), np.frombuffer(lengths, np.uint16).tolist(), strict=True))
        self.cache = Cache(lambda new: count(self.tokenizer, new), CACHED)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def totals(self, texts: list[str | None], pattern: regex.Pattern) -> list[int]:
        """The texts' numbers of tokens; what the table misses is looked up for all of them at once."""
        sums, missed, rare = [], [], []
        for text in texts:
            if not text:
                found = []
            elif any(s in text for s in self.special):
                found = None  # the library cuts there before it looks for pre-tokens
            else:
                found = groups(text, pattern)
            got = list(map(self.table.get, found or ()))
            before = len(rare)
            rare += [g for g, n in zip(found or (), got, strict=True) if n is None]
            missed.append(len(rare) - before)
            sums.append(count(self.tokenizer, [text])[0] if found is None else sum(filter(None, got)))
        counts = iter(self.cache.get(rare))
        return [n + sum(islice(counts, m)) for n, m in zip(sums, missed, strict=True)]


def count(tokenizer, texts: list[str]) -> list[int]:
    """Numbers of tokens by the library, without added ones."""
    return [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def count_tokens(docs: DataFrame, path: str, pattern: str, text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``docs`` and a struct ``tokens``: n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    ``path`` is a byte-level tokenizer whose pre-tokens are the matches of ``pattern``; its special
    strings count as it counts them by default. A null or empty text has 0 bytes and tokens, no rows give
    no rows. The struct's name is lengthened if ``docs`` has it; rows and other columns stay as they are.
    """
    frequent = frequent_groups(docs, pattern, text_col)
    lengths = np.array(count(tokenizer_at(path), frequent), np.uint16).tobytes()
    frequent, lengths = (frequent, lengths) if frequent else ([""], np.zeros(1, np.uint16).tobytes())
    # At most FREQUENT * (4 * LONGEST + 3) bytes.
    table = docs.sparkSession.sparkContext.broadcast(("\0".join(frequent).encode(), lengths))
    name, text = free_name(docs, "tokens"), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = kept((path, hash(table.value)), lambda: Counts(path, *table.value), slot="counts")
        cut = regex.compile(pattern)
        for batch in slices(batches, text):
            found = counts.totals(batch.column(text).to_pylist(), cut)
            size = pc.fill_null(pc.binary_length(raw(batch.column(text))), 0).cast(pa.int64())
            n = pa.array(found, pa.int64())
            struct = pa.StructArray.from_arrays([size, n, pc.greater(n, limit)], ["n_bytes", "n_tokens", "over_limit"])
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], [*batch.schema.names, name])

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return ready(docs).mapInArrow(run, f"{fields}, {name} struct<n_bytes: bigint, n_tokens: bigint, over_limit: boolean>")
