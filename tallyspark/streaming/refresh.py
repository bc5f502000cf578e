"""Structured Streaming for the weekly refresh: new rows replace those with their key, whenever they come.

The table is a folder of versions, each a whole set of partitions, and a manifest of one small file for each version. A batch writes the partitions
that it touches under a name of its own, then names them in a new manifest; what readers see changes with that one file. Nothing that is read is ever
overwritten, so a write that fails half-way leaves the last version as it was, and a batch that runs again changes nothing: its rows are
there already and replace themselves.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.tables import upsert


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """(version, partition -> folder) of the last whole version; (-1, {}) where there is none."""
    store, folder = _store(spark, f"{path}/_versions")
    if not store.exists(folder):
        return -1, {}
    names = [x.getPath().getName() for x in store.listStatus(folder)]
    last = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=-1)
    if last < 0:
        return -1, {}
    text = "".join(r[0] for r in spark.read.text(f"{path}/_versions/{last:09d}.json").collect())
    return last, json.loads(text)


def _publish(spark: SparkSession, path: str, version: int, parts: dict[str, str]) -> None:
    """Writes a manifest beside its place and renames it, so it is there as a whole or not at all."""
    store, target = _store(spark, f"{path}/_versions/{version:09d}.json")
    _, draft = _store(spark, f"{path}/_versions/.{version:09d}")
    out = store.create(draft, True)
    out.write(bytearray(json.dumps(parts, sort_keys=True).encode()))
    out.close()
    if not store.rename(draft, target):
        raise OSError(f"{target} cannot be written")


def read_version(spark: SparkSession, path: str, schema, only: list[str] | None = None) -> DataFrame:
    """The table as of its last whole version, or the named partitions of it."""
    _, parts = manifest(spark, path)
    folders = [f"{path}/{folder}" for key, folder in sorted(parts.items()) if only is None or key in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def refresh(stream: DataFrame, path: str, keys: list[str], by: list[str], tie: list, checkpoint: str) -> StreamingQuery:
    """Upserts each micro-batch into the table at ``path``; only partitions that a batch touches are written anew. A row never changes its
    partition. Partitions of a batch are listed on the driver, so they must be few, like the seasons and weeks of a refresh."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        key = F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in by])
        touched = [r[0] for r in batch.select(key.alias("k")).distinct().collect()]
        if not touched:
            return
        last, parts = manifest(spark, path)
        old = [f"{path}/{parts[k]}" for k in touched if k in parts]
        rows = spark.read.schema(batch.schema).parquet(*old) if old else batch.limit(0)
        place = F.create_map(*[F.lit(x) for n, k in enumerate(touched) for x in (k, n)])
        folder = f"batch={number}/version={last + 1}"
        fresh = upsert(rows, batch, keys, tie).withColumn("__part", place[key])
        fresh.repartition("__part").write.mode("overwrite").partitionBy("__part").parquet(f"{path}/{folder}")
        _publish(spark, path, last + 1, parts | {k: f"{folder}/__part={n}" for n, k in enumerate(touched)})

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
