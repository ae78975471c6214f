"""Writers: audited publish, date-partitioned archive, CSV export, views, gold tables."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

# The gold tables that a deployment must contain.
GOLD_TABLES = (
    "route_reliability_scores", "corridor_priority_ranking", "hourly_bunching_pattern",
    "bunching_hotspots_with_stops", "route_type_summary",
)


class PublishError(ValueError):
    """A batch that must not become visible."""


def partitioned_sink(df: DataFrame, path: str, by: str = "date", mode: str = "append") -> str:
    """Append snappy Parquet under one folder per date.

    The rebalance hint lets adaptive execution split a day that is much larger than the others
    and join small ones, so files stay even without a day ever being forced into one task.
    """
    (
        df.hint("rebalance", by).write.mode(mode).partitionBy(by)
        .option("compression", "snappy").parquet(path)
    )
    return path


def validated_publish(
    df: DataFrame, staging: str, target: str, required: Sequence[str], mode: str = "append",
    expected_rows: int | None = None,
) -> dict[str, int]:
    """Write to staging, compare, then promote.

    The batch is computed once: its rows are counted while they are written. Columns and rows of
    the staged copy (its count comes from file footers) are checked before anything reaches the
    target; an empty or incomplete batch is rejected. Promotion renames the staged files.
    """
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise PublishError("missing columns: " + ", ".join(missing))
    spark, seen = df.sparkSession, Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").option("compression", "snappy").parquet(staging)
    written = seen.get["rows"]
    if written == 0:
        raise PublishError("empty batch")
    staged = spark.read.parquet(staging)
    if sorted(staged.columns) != sorted(df.columns):
        raise PublishError("staged columns differ from the batch")
    rows = staged.count()
    if rows != (written if expected_rows is None else expected_rows):
        raise PublishError(f"staged {rows} rows of {written if expected_rows is None else expected_rows}")
    _promote(spark, staging, target, mode)
    return {"rows": rows, "columns": len(staged.columns)}


def _promote(spark: SparkSession, staging: str, target: str, mode: str) -> None:
    """Move the staged data files into the target folder; their names are unique to the write."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, goal = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(target)
    fs = source.getFileSystem(conf)
    if mode == "overwrite":
        fs.delete(goal, True)
    fs.mkdirs(goal)
    for status in fs.listStatus(source):
        path = status.getPath()
        if path.getName().startswith("part-") and not fs.rename(path, jvm.org.apache.hadoop.fs.Path(goal, path.getName())):
            raise PublishError(f"could not promote {path.getName()}")
    fs.delete(source, True)


class _Store:
    """The Hadoop file system of a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        place = self.path(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(place)) if self.fs.exists(place) else []

    def put(self, name: str, text: str) -> None:
        """Make a small file appear whole, or not at all; an existing one is never replaced."""
        draft = self.path(f"{name}.{os.urandom(6).hex()}.draft")
        out = self.fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(self.path(name)) or not self.fs.rename(draft, self.path(name)):
            self.fs.delete(draft, False)
            raise PublishError(f"another writer made {name}")

    def text(self, spark: SparkSession, name: str) -> str:
        return "\n".join(r[0] for r in spark.read.text(name).collect())


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file with the given bytes."""
    store = _Store(spark, path)
    out = store.fs.create(store.path(path), True)
    out.write(bytearray(content))
    out.close()


def publish_version(
    df: DataFrame, root: str, required: Sequence[str], mode: str = "overwrite", expected_rows: int | None = None, keep: int = 2,
) -> dict[str, int]:
    """Publish a batch as a new version of a table: its files, then one manifest that names them.

    The files are written and checked in a folder of their own (see `validated_publish`). Only the
    manifest makes them visible, and it appears in one step, so a reader sees the old version or the
    new one, whatever fails in between. `append` names the folders of the old version too. Manifests
    before the newest `keep`, and folders that no remaining one names, are removed at the end; a
    folder left by a failed writer stays until then. One writer at a time.
    """
    spark, store = df.sparkSession, _Store(df.sparkSession, root)
    before = _manifests(store, root)
    old = json.loads(store.text(spark, f"{root}/_manifests/{before[-1]}"))["folders"] if before and mode == "append" else []
    own = f"data-{os.urandom(8).hex()}"
    report = validated_publish(df, f"{root}/_staging-{own}", f"{root}/{own}", required, "append", expected_rows)
    number = int(before[-1]) + 1 if before else 1
    store.put(f"{root}/_manifests/{number:012d}", json.dumps({"folders": [*old, own], "rows": report["rows"]}))
    _forget(spark, store, root, keep)
    return report | {"version": number}


def _manifests(store: _Store, root: str) -> list[str]:
    return [n for n in store.names(f"{root}/_manifests") if n.isdigit()]


def _forget(spark: SparkSession, store: _Store, root: str, keep: int) -> None:
    known = _manifests(store, root)
    for name in known[:-keep]:
        store.fs.delete(store.path(f"{root}/_manifests/{name}"), False)
    used = {f for n in known[-keep:] for f in json.loads(store.text(spark, f"{root}/_manifests/{n}"))["folders"]}
    for name in store.names(root):
        if name.startswith("data-") and name not in used:
            store.fs.delete(store.path(f"{root}/{name}"), True)


def read_published(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The newest version of a published table, or an older one that is still kept."""
    store = _Store(spark, root)
    known = _manifests(store, root)
    name = known[-1] if known and version is None else f"{version or 0:012d}"
    if name not in known:
        raise PublishError(f"no version {version or ''} of {root}")
    return spark.read.parquet(*(f"{root}/{f}" for f in json.loads(store.text(spark, f"{root}/_manifests/{name}"))["folders"]))


def csv_sink(df: DataFrame, path: str) -> bool:
    """Export with a header; an empty result writes nothing."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").csv(path, header=True)
    return True


def replace_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def replace_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Create or replace a saved table, as an external one where a path is given."""
    writer = df.write.mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def gold_publish(
    tables: Mapping[str, DataFrame], root: str, allowed: Sequence[str] = GOLD_TABLES
) -> dict[str, int]:
    """Publish exactly the allowed gold tables; any absent one fails before a write starts."""
    absent = [t for t in allowed if t not in tables]
    if absent:
        raise PublishError("gold tables absent: " + ", ".join(absent))
    rows = {}
    for name in allowed:
        tables[name].write.mode("overwrite").parquet(f"{root}/{name}")
        rows[name] = tables[name].sparkSession.read.parquet(f"{root}/{name}").count()
    return rows


def catalog_report(spark: SparkSession, prefix: str = "") -> DataFrame:
    """Rows per catalog table or view whose name starts with the prefix."""
    names = sorted(t.name for t in spark.catalog.listTables() if t.name.startswith(prefix))
    if not names:
        return spark.createDataFrame([], "table_name string, row_count bigint")
    out = None
    for n in names:
        one = spark.table(n).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out
