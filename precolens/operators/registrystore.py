"""A stored keyed table whose changes rewrite only the files that hold a changed row.

Data files are never changed. A version is a small table that names the files in force; a change writes new files for
the rows of the touched ones and then the next version, which takes effect as a whole. Readers of an older
version keep its files. Two writers cannot make the same version: the later one fails and may try again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ROSTER
from . import maintenance

KEY = "id"
_NAMES = "arquivo string"


class RegistryStore:
    """The roster table under ``path``: ``dados`` holds its files, ``versoes`` the lists of those in force."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- versions ---

    def _listed(self, folder: str) -> list[str]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        files = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []

    def version(self) -> int:
        """The newest version that was written to its end; 0 without any."""
        for name in reversed(self._listed("versoes")):
            if "_SUCCESS" in self._listed(f"versoes/{name}"):
                return int(name)
        return 0

    def files(self, version: int | None = None) -> list[str]:
        """The names of the files in force, as folder/file."""
        version = self.version() if version is None else version
        if not version:
            return []
        rows = self.spark.read.schema(_NAMES).parquet(f"{self.path}/versoes/{version:010d}")
        return sorted(r.arquivo for r in rows.collect())  # names of files, as a reader lists them anyway

    def _publish(self, files: list[str], after: int) -> int:
        names = self.spark.createDataFrame([(f,) for f in files], _NAMES).coalesce(1)
        names.write.mode("errorifexists").parquet(f"{self.path}/versoes/{after + 1:010d}")
        return after + 1

    def _add(self, rows: DataFrame) -> list[str]:
        """Write rows, sorted by key within files, and give the new files' names."""
        folder = uuid.uuid4().hex
        rows.select(*ROSTER.fieldNames()).sortWithinPartitions(KEY).write.parquet(f"{self.path}/dados/{folder}")
        return [f"{folder}/{name}" for name in self._listed(f"dados/{folder}") if name.endswith(".parquet")]

    # --- reading ---

    def _of(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], ROSTER)
        return self.spark.read.schema(ROSTER).parquet(*(f"{self.path}/dados/{f}" for f in files))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        return self._of(self.files(version))

    def touched(self, keys: DataFrame, files: list[str]) -> list[str]:
        """Those of the files that hold a row with one of the keys: a scan of the key column and the files' names."""
        if not files:
            return []
        place = F.substring_index(F.col("_metadata.file_path"), "/", -2)
        named = self._of(files).select(KEY, place.alias("arquivo"))
        found = named.join(keys.select(KEY).distinct(), KEY, "left_semi").select("arquivo").distinct()
        return sorted(r.arquivo for r in found.collect())

    # --- changes ---

    def create(self, rows: DataFrame, files: int = 8) -> int:
        """The first version: files by ranges of the key, so that neighbouring keys share one."""
        return self._publish(self._add(rows.repartitionByRange(files, KEY)), self.version())

    def _rewrite(self, keys: DataFrame, change) -> int:
        version = self.version()
        files = self.files(version)
        old = self.touched(keys, files)
        if not old:
            return version
        new = self._add(change(self._of(old)))
        return self._publish(sorted({*files, *new} - set(old)), version)

    def update(self, changes: DataFrame, columns: list[str]) -> int:
        """Apply a change set as :func:`maintenance.update_keyed` does; the new version, or the old one if nothing is touched."""
        return self._rewrite(changes, lambda rows: maintenance.update_keyed(rows, changes, columns))

    def delete(self, keys: DataFrame) -> int:
        """Delete rows as :func:`maintenance.delete_keys` does."""
        return self._rewrite(keys, lambda rows: maintenance.delete_keys(rows, keys))

    def insert(self, batch: DataFrame) -> int:
        """Insert the accepted rows of a batch, in files of their own; the table's ids and names alone are read."""
        version = self.version()
        accepted = maintenance.accepted_rows(self.read(version), batch)
        return self._publish(sorted({*self.files(version), *self._add(accepted)}), version)
