"""Commits of several tables at once: numbered batches, then a manifest that makes them visible.

A run writes each table's batch into a folder of its number and the manifest of that number
last, by a rename. Readers follow the newest manifest and see batches up to its number only, so
a run that dies in between changes nothing that can be seen, and the next run writes the same
folders anew. A manifest holds the number, the high-water mark of each table and the runs of
the snapshots; it doesn't grow with the archive.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.operators.archive import KEY, Run
from calibra.operators.storage import append_once, newest_version


@dataclass(frozen=True)
class Manifest:
    number: int = 0
    marks: dict[str, int] = field(default_factory=dict)
    tables: tuple[str, ...] = ()
    snapshots: dict[str, int] = field(default_factory=dict)
    at: int = 0


def declared_type(declared: str) -> str:
    """Spark type of a column by its declared type's affinity: INT, text, blob or none, else a double."""
    d = declared.upper()
    if "INT" in d:
        return "bigint"
    if any(k in d for k in ("CHAR", "CLOB", "TEXT")):
        return "string"
    return "binary" if "BLOB" in d or not d else "double"


class Store:
    """Tables in one folder of a file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # Manifests are single small files; Hadoop's file system gives the rename that data frames lack.
    def _files(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(f"{self.path}/manifests")
        return hadoop, folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self, number: int | None = None) -> Manifest:
        """The newest manifest, or the newest up to a number; one of number 0 before the first commit."""
        _, folder, files = self._files()
        if not files.exists(folder):
            return Manifest()
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        found = [int(n[:-5]) for n in names if n.endswith(".json") and (number is None or int(n[:-5]) <= number)]
        if not found:
            return Manifest()
        text = self.spark.read.text(f"{self.path}/manifests/{max(found):08d}.json", wholetext=True).first()[0]
        told = json.loads(text)
        return Manifest(told["number"], told["marks"], tuple(told["tables"]), told["snapshots"], told["at"])

    def _publish(self, manifest: Manifest) -> None:
        hadoop, folder, files = self._files()
        files.mkdirs(folder)
        name = f"{manifest.number:08d}"
        made, final = hadoop.Path(folder, f".{name}.tmp"), hadoop.Path(folder, f"{name}.json")
        out = files.create(made, True)
        out.write(bytearray(json.dumps(manifest.__dict__ | {"tables": list(manifest.tables)}).encode()))
        out.close()
        if files.exists(final) or not files.rename(made, final):
            raise RuntimeError(f"manifest {name} was written by another run")

    def write_batch(self, table: str, rows: DataFrame, number: int) -> None:
        """A table's batch of a number, over what a run that died may have left; not visible yet."""
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{table}/_batch={number}")

    def commit(self, batches: Mapping[str, DataFrame], snapshots: Mapping[str, DataFrame] = {}, marks: Mapping[str, int] = {}, at: int = 0) -> Manifest:
        """Write batches and whole small tables as one visible step."""
        old = self.manifest()
        number = old.number + 1
        for table, rows in batches.items():
            self.write_batch(table, rows, number)
        for table, rows in snapshots.items():
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/snapshots/{table}/_run={number}")
        new = Manifest(number, old.marks | dict(marks), tuple(sorted({*old.tables, *batches})), old.snapshots | dict.fromkeys(snapshots, number), at)
        self._publish(new)
        return new

    def export(self, tables: Mapping[str, tuple[DataFrame, str]], snapshots: Mapping[str, DataFrame] = {}, at: int = 0) -> Manifest:
        """Commit of what is new: rows of each table (rows, version column) from its last mark on.

        The mark is included, since a row that replaces the newest one may keep its version;
        readers take the newest row of a key, so a row that comes twice costs nothing. Nothing
        is written if no table has a new version and there are no snapshots."""
        old, batches, marks = self.manifest(), {}, {}
        for table, (rows, version) in tables.items():
            (high,) = rows.agg(F.max(version)).first()
            low = old.marks.get(table)
            if high is None or (low is not None and high <= low):
                continue
            new = rows.where(F.col(version) <= high)
            batches[table], marks[table] = new if low is None else new.where(F.col(version) >= low), int(high)
        return self.commit(batches, snapshots, marks, at) if batches or snapshots else old

    def rows(self, table: str, schema: str, number: int | None = None) -> DataFrame:
        """All visible rows of a table with _batch, of the newest manifest or of an older one."""
        seen = self.manifest(number)
        if table not in seen.tables:
            return self.spark.createDataFrame([], f"{schema}, _batch int")
        stored = self.spark.read.schema(f"{schema}, _batch int").option("basePath", f"{self.path}/{table}").parquet(f"{self.path}/{table}")
        return stored.where(F.col("_batch") <= seen.number)

    def current(self, table: str, schema: str, key: list[str], version: str, number: int | None = None) -> DataFrame:
        """The newest row of each key: by version, then by batch."""
        return newest_version(self.rows(table, schema, number), key, [F.desc(version), F.desc("_batch")]).drop("_batch")

    def snapshot(self, table: str, number: int | None = None) -> DataFrame:
        """A small table as of its last snapshot up to the manifest."""
        return self.spark.read.parquet(f"{self.path}/snapshots/{table}/_run={self.manifest(number).snapshots[table]}")

    def create_views(self) -> list[str]:
        """A temporary view of each snapshot table; their names."""
        names = sorted(self.manifest().snapshots)
        for name in names:
            self.snapshot(name).createOrReplaceTempView(name)
        return names


def commit_scores(store: Store, run: Run, rows_schema: str, states_schema: str, at: int) -> Manifest:
    """Archive rows and model states of a run as one step; a run that is committed again adds nothing.

    The archive is frozen: a row whose key is there is passed over. States replace each other:
    readers take the newest of a series."""
    key = [*KEY, "bin_start"]
    new = append_once(run.rows, store.rows("surprise", rows_schema), key)
    if new.isEmpty():
        return store.manifest()
    return store.commit({"surprise": new, "model_state": run.states}, at=at)
