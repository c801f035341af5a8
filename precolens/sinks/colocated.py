"""Co-located storage: fact and registry in buckets of their join key, so that the view is joined without a shuffle.

Both tables are dealt to the same buckets by (supplier code, product id, slice). A key with more than
``ROWS_PER_SLICE`` fact rows has several slices, and its registry rows are stored once in each, so that no bucket
grows with one key. Slices only ever become more: an append adds those that a batch needs to the registry and
leaves what is stored as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.packed import packed, unpacked
from ..operators.enrich import KEY, REGISTRY_TIES, registry_by_text_key, with_code
from ..schemas import COLETA, VISIBLE_COLUMNS
from ..session import CODEC, Measured, durable, measured, written

SLICE = "fatia"
JOINED = [*KEY, SLICE]

# Fact rows of one key that stay together, and rows that a bucket is meant for: one task sorts them, in memory.
ROWS_PER_SLICE = 1 << 18
ROWS_PER_BUCKET = 1 << 18

# The numbers of buckets that are chosen; Spark allows 100,000.
LEAST_BUCKETS, MOST_BUCKETS = 8, 1 << 16

# Groups of keys that are counted first: a key is large only if its group is.
KEY_GROUPS = 1 << 16

_PLAIN = ["_codigo", "_produto"]


def _large_keys(coded: DataFrame) -> tuple[int, Measured | None]:
    """The number of rows, and rows (_codigo, _produto, fatias) of the keys that need more than one slice, None without any.

    NULLs are a key, too. Rows are counted by groups of keys; keys are counted in groups with many rows only.
    """
    group = F.pmod(F.xxhash64(*KEY), F.lit(KEY_GROUPS)).alias("_grupo")
    sizes = durable(coded.select(group).groupBy("_grupo").agg(F.count("*").alias("n")))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = sizes.where(F.col("n") > ROWS_PER_SLICE).select("_grupo")
    if groups.isEmpty():
        return total, None
    rows = coded.select(*KEY, group).join(F.broadcast(groups), "_grupo", "left_semi")  # KEY_GROUPS rows at most
    counts = rows.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") > ROWS_PER_SLICE)
    plain = [F.col(k).alias(p) for k, p in zip(KEY, _PLAIN, strict=True)]
    found = measured(counts.select(*plain, F.ceil(F.col("n") / ROWS_PER_SLICE).alias("fatias")))
    return total, found if found.count else None


def _beside(rows: DataFrame, slices: DataFrame) -> DataFrame:
    same = [F.col(k).eqNullSafe(F.col(p)) for k, p in zip(KEY, _PLAIN, strict=True)]
    return rows.join(slices, same, "left").drop(*_PLAIN)


def _sliced(coded: DataFrame, found: Measured | None) -> DataFrame:
    """Fact rows with their slice. Rows of large keys, copies among them, are dealt by their number in a written table."""
    if found is None:
        return coded.withColumn(SLICE, F.lit(0))
    rows = _beside(coded, found.side)
    large = written(rows.where("fatias is not null").withColumn("_n", F.monotonically_increasing_id()), "fatias")
    place = F.pmod("_n", "fatias").cast("int")
    small = rows.where("fatias is null").drop("fatias").withColumn(SLICE, F.lit(0))
    return small.unionByName(large.withColumn(SLICE, place).drop("_n", "fatias"))


class ColocatedStore:
    """Two bucketed catalogue tables under one folder; ``name`` is their common beginning."""

    def __init__(self, spark: SparkSession, name: str, path: str):
        self.spark, self.path = spark, path
        self.fact_table, self.registry_table = f"{name}_coleta", f"{name}_cadastro"

    def create(self, fact: DataFrame, registry: DataFrame, buckets: int | None = None) -> None:
        """Store both tables anew, with buckets for the fact's present size unless their number is given."""
        coded = with_code(fact)
        count, large = _large_keys(coded)
        self.buckets = buckets or min(max(LEAST_BUCKETS, -(-count // ROWS_PER_BUCKET)), MOST_BUCKETS)
        self._write(_sliced(coded, large), self.fact_table, "coleta", "overwrite")
        self.replace_registry(registry)

    def replace_registry(self, registry: DataFrame) -> None:
        """Store another registry; the fact's slices tell how often a key's rows are stored."""
        sliced = self.spark.table(self.fact_table).where(F.col(SLICE) > 0).groupBy(*KEY).agg((F.max(SLICE) + 1).alias("fatias"))
        slices = measured(sliced.withColumnsRenamed(dict(zip(KEY, _PLAIN, strict=True))))
        rows = _beside(registry_by_text_key(registry).select(*KEY, *REGISTRY_TIES), slices.side)
        each = F.explode(F.sequence(F.lit(0), F.coalesce("fatias", F.lit(1)).cast("int") - 1))
        self._write(rows.withColumn(SLICE, each).drop("fatias"), self.registry_table, "cadastro", "overwrite")

    def append(self, rows: DataFrame) -> None:
        """Add fact rows. The registry first gets the slices it lacks, so that an append that failed can be run again.

        The batch is stored first, since it is read twice: to count its keys and to write it.
        """
        coded = written(with_code(rows), "lote")
        stored = self.spark.table(self.registry_table)
        # Only keys of the batch that are large can lack any.
        _, wanted = _large_keys(coded)
        if wanted is not None:
            same = [F.col(k) == F.col(p) for k, p in zip(KEY, _PLAIN, strict=True)]
            held = stored.join(wanted.side, same)
            known = held.groupBy(*KEY).agg((F.max(SLICE) + 1).alias("tem"))
            lacking = measured(known.withColumnsRenamed(dict(zip(KEY, _PLAIN, strict=True))))
            missing = held.where(F.col(SLICE) == 0).drop(*_PLAIN).join(lacking.side, same).where("tem < fatias")
            each = F.explode(F.sequence(F.col("tem").cast("int"), F.col("fatias").cast("int") - 1))
            added = missing.withColumn(SLICE, each).select(*KEY, *REGISTRY_TIES, SLICE)
            self._write(written(added, "fatias"), self.registry_table, "cadastro", "append")
        self._write(_sliced(coded, wanted), self.fact_table, "coleta", "append")

    def _write(self, rows: DataFrame, table: str, folder: str, mode: str) -> None:
        """One file per bucket; a bucket's rows are sorted by its first column after the key, for row-group skipping."""
        columns = [*JOINED, *[c for c in rows.columns if c not in JOINED]]
        order = "data_coleta" if "data_coleta" in columns else "id_produto"
        dealt = packed(rows.select(*columns), JOINED).repartition(self.buckets, *JOINED)
        (
            unpacked(dealt, columns)
            .write.mode(mode)
            .options(path=f"{self.path}/{folder}", compression=CODEC)
            .bucketBy(self.buckets, *JOINED)
            .sortBy(order)
            .saveAsTable(table)
        )

    def fact(self) -> DataFrame:
        """The stored fact rows, the supplier code a scalar."""
        return self.spark.table(self.fact_table).select(*COLETA.fieldNames())

    def enriched(self) -> DataFrame:
        """The enriched view: both tables are joined bucket by bucket; a small registry is broadcast as ever."""
        fact, registry = self.spark.table(self.fact_table), self.spark.table(self.registry_table)
        return fact.join(registry, JOINED, "left").select(*VISIBLE_COLUMNS)

    def drop(self) -> None:
        """Take both tables out of the catalogue; their files stay, and so do DataFrames made before."""
        for table in (self.fact_table, self.registry_table):
            self.spark.sql(f"drop table if exists {table}")
