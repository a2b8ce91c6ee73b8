"""Table snapshots: metadata facts, ancestry and a bounded probe of physical files."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.columns import quote


def file_aggregates(files: DataFrame) -> DataFrame:
    """One row of file counts from a table's file metadata (``content`` 0 is data, others are deletes)."""
    return files.agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if(F.col("content") == 0).alias("data_files"), F.count_if(F.col("content") != 0).alias("delete_files"),
        F.count_distinct("spec_id").alias("active_partition_spec_count"),
    )


def _walk(snapshots: DataFrame, snapshot_id: int) -> Iterator[int]:
    """A snapshot and its ancestors, until the root, an unknown parent or a cycle.  The table's history has one row of two
    numbers a snapshot; it is read by the driver, which also has the table's metadata."""
    parents = {r[0]: r[1] for r in snapshots.select(F.col("snapshot_id").cast("long"), F.col("parent_id").cast("long")).toLocalIterator()}
    seen: set[int] = set()
    at: int | None = snapshot_id
    while at in parents and at not in seen:
        yield at
        seen.add(at)
        at = parents[at]


def ancestry(snapshots: DataFrame, snapshot_id: int) -> DataFrame:
    """Rows ``(snapshot_id, depth)``: a snapshot and all of its ancestors, however many."""
    rows = [(s, depth) for depth, s in enumerate(_walk(snapshots, int(snapshot_id)))]
    return snapshots.sparkSession.createDataFrame(rows, "snapshot_id long, depth int")


def is_ancestor(snapshots: DataFrame, snapshot_id: int, ancestor: int) -> bool:
    """Whether ``ancestor`` is the snapshot or before it; cycles and lost parents end the walk."""
    return ancestor in _walk(snapshots, snapshot_id)


@dataclass
class FileProbe:
    performed: bool
    checked: int = 0
    missing: int = 0
    size_mismatches: int = 0
    errors: int = 0
    complete: bool = False


def probe_files(files: DataFrame, limit: int) -> FileProbe:
    """Existence and length of at most ``limit`` files through the cluster's file system; one more row is asked for to
    know whether these are all."""
    if limit <= 0:
        return FileProbe(False)
    spark = files.sparkSession
    rows = files.select("file_path", "file_size_in_bytes").limit(limit + 1).collect()
    out = FileProbe(True, complete=len(rows) <= limit)
    for r in rows[:limit]:
        out.checked += 1
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(r.file_path)
            fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
            if not fs.exists(path):
                out.missing += 1
            elif fs.getFileStatus(path).getLen() != r.file_size_in_bytes:
                out.size_mismatches += 1
        except Exception:  # a file that cannot be asked for is counted, not hidden
            out.errors += 1
    return out


@dataclass
class Snapshot:
    """Rows and metadata of one table at one snapshot, captured once."""

    identifier: str
    snapshot_id: int
    frame: DataFrame
    files: DataFrame
    manifests: DataFrame
    snapshots: DataFrame
    history: DataFrame
    spark: SparkSession
    captured_schema_id: int | None = None

    def current_spec_id(self) -> int | None:
        """The partition spec that the table has now."""
        return int(_table(self.spark, self.identifier).spec().specId())

    def current_id(self) -> int | None:
        row = self.history.sparkSession.table(f"{self.identifier}.history").orderBy(F.desc("made_current_at")).first()
        return row.snapshot_id if row else None


def _table(spark: SparkSession, name: str):
    """The table format's own handle, refreshed: some metadata is in no metadata table."""
    table = spark._jvm.org.apache.iceberg.spark.Spark3Util.loadIcebergTable(spark._jsparkSession, name)
    table.refresh()
    return table


def load_snapshot(spark: SparkSession, identifier: str, snapshot_id: int | None = None) -> Snapshot:
    """Bind rows and metadata of an Iceberg table to its current or a given snapshot.  The table format's library must be
    on the session's class path."""
    parts = identifier.split(".")
    if any(not p or not p.replace("_", "").replace("-", "").isalnum() for p in parts):
        raise ValueError("a table identifier is made of plain names and dots")
    name = ".".join(quote(p) for p in parts)
    history = spark.table(f"{name}.history")
    if snapshot_id is None:
        row = history.orderBy(F.desc("made_current_at")).first()
        if row is None:
            raise ValueError("the table was never written")
        snapshot_id = row.snapshot_id

    def at(suffix: str = "") -> DataFrame:
        return spark.read.format("iceberg").option("snapshot-id", snapshot_id).load(identifier + suffix)

    captured = _table(spark, name).snapshot(snapshot_id)
    if captured is None:
        raise ValueError(f"the table has no snapshot {snapshot_id}")
    schema_id = captured.schemaId()
    return Snapshot(name, snapshot_id, at(), at(".files"), at(".manifests"), spark.table(f"{name}.snapshots"), history, spark, None if schema_id is None else int(schema_id))
