"""Helpers that the operators share: reading tables, sending code to workers, bounded Arrow slices."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from precolens.session import scratch_path

ROOT = str(Path(__file__).resolve().parents[2])
# Text that a worker handles at once; Arrow batches are cut to about this many bytes.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(df: DataFrame) -> DataFrame:
    """``df``, with this package importable in Python workers of a local session.

    A cluster installs the package or gets it by ``--py-files``; there the path changes nothing.
    """
    env = df.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def raw(column: pa.Array) -> pa.Array:
    """A string column as bytes, without copying."""
    return column if pa.types.is_binary(column.type) else pc.cast(column, pa.binary())


def slices(batches: Iterable[pa.RecordBatch], text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the bytes in column ``text`` stay near ``limit``; a longer row stays whole."""
    for batch in batches:
        start, size = 0, 0
        lengths = pc.fill_null(pc.binary_length(raw(batch.column(text))), 0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, written once with the given options."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tokenizer_at(path: str):
    """The tokenizer in a file, without a thread pool of its own: workers run side by side already."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Cache:
    """Values by key for a worker: ``make`` gives those of a list of new keys.

    At most about twice ``room`` entries are held; when the young ones reach it they become the old
    ones, and old ones that nobody asked for since are dropped.
    """

    def __init__(self, make: Callable[[list], Iterable], room: int):
        self.make, self.room = make, room
        self.young: dict = {}
        self.old: dict = {}

    def get(self, keys: list) -> list:
        got = list(map(self.young.get, keys))
        if None in got:
            missing = {k for k, g in zip(keys, got, strict=True) if g is None}
            found = {k: self.old[k] for k in missing if k in self.old}
            new = [k for k in missing if k not in found]
            found.update(zip(new, self.make(new), strict=True))
            if len(self.young) + len(found) > self.room:
                self.old, self.young = self.young, {}
            self.young.update(found)
            got = [found[k] if g is None else g for k, g in zip(keys, got, strict=True)]
        return got


_KEPT: dict = {}


def kept(key, make: Callable, slot=None):
    """What ``make()`` gave for ``key`` in this worker process; later tasks use it again.

    A slot holds one value, so that a worker that outlives a query drops what the next one replaces.
    """
    slot = key if slot is None else slot
    if slot not in _KEPT or _KEPT[slot][0] != key:
        _KEPT.pop(slot, None)
        _KEPT[slot] = (key, make())
    return _KEPT[slot][1]
