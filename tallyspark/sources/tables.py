"""Reading and writing: typed tables, CSV with text booleans, partitioned caches, incremental loads."""

from __future__ import annotations

import atexit
import hashlib
import json
import random
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import first_by

#: Columns of the tables that queries read; a table is read with its schema, never by inference.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def run_query(spark: SparkSession, sql: str, params: dict | None = None) -> DataFrame:
    """SQL with named parameters."""
    return spark.sql(sql, args=params or {})


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)


def read_csv(spark: SparkSession, path: str, schema: str, booleans: tuple[str, ...] = (), renames: dict[str, str] | None = None) -> DataFrame:
    """CSV with a header. ``booleans`` hold TRUE / FALSE in any case; other text there is null."""
    df = spark.read.schema(schema).csv(path, header=True)
    repaired = {c: F.when(F.upper(c) == "TRUE", True).when(F.upper(c) == "FALSE", False) for c in booleans}
    return df.withColumns(repaired).withColumnsRenamed(renames or {})


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``. A temporary folder stands in where that is unset, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: files need a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tallyspark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
    return f"{base}/{name}-{uuid.uuid4().hex}"


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces the partitions that the rows belong to and leaves the others; rows meet by partition before they are written."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def missing_slots(calendar: DataFrame, loaded: DataFrame, keys: list[str]) -> DataFrame:
    """The slots of the calendar that hold no row yet."""
    return calendar.join(loaded.select(*keys).distinct(), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], tie: list | None = None) -> DataFrame:
    """The old rows with the new ones in place of those with equal keys. Of new rows with one key the first in ``tie`` counts."""
    fresh = first_by(new, keys, tie) if tie else new.dropDuplicates(keys)
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows, and new ones whose key is not there; null keys are never there."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti"))


def _exists(spark: SparkSession, path: str) -> bool:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def append_missing(df: DataFrame, path: str, done_by: list[str]) -> DataFrame:
    """Appends the rows whose key the table at the path does not hold yet, and returns the table: a run that was broken off goes on."""
    spark = df.sparkSession
    if _exists(spark, path):
        df = df.join(spark.read.schema(df.schema).parquet(path).select(*done_by).distinct(), done_by, "left_anti")
    df.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pull_calendar(spark: SparkSession, seasons: list[int], weeks: list[int], pull: Callable[[int, int], list[tuple]], schema: str, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """The rows of all seasons and weeks. Slots are dealt to tasks, each of which pulls its own, with retries; nothing passes the driver."""
    slots = spark.createDataFrame([(s, w) for s in seasons for w in weeks], "season int, week int").repartition(max(1, min(len(seasons) * len(weeks), 200)))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames):
        for frame in frames:
            for s, w in frame[["season", "week"]].itertuples(index=False):
                rows = with_retry(lambda s=s, w=w: pull(int(s), int(w)), attempts, sleep=sleep)
                yield pd.DataFrame([(int(s), int(w), *r) for r in rows], columns=["season", "week", *names])

    return slots.mapInPandas(run, f"season int, week int, {schema}")


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small table as a markdown report; a longer one is an error, not a part of it."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    cell = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]
    return f"## {title}\n\n" + "\n".join(lines) + "\n"


def load_config(path: str, env: dict[str, str]) -> dict:
    """A YAML or JSON file; a value that is ${NAME} is that of the environment, and an error where it has none."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("YAML files need PyYAML; write the configuration as JSON") from e
        raw = yaml.safe_load(text)
    else:
        raw = json.loads(text)

    def resolved(x):
        if isinstance(x, dict):
            return {k: resolved(v) for k, v in x.items()}
        if isinstance(x, list):
            return [resolved(v) for v in x]
        if isinstance(x, str) and (m := re.fullmatch(r"\$\{(\w+)\}", x.strip())):
            if m[1] not in env:
                raise ValueError(f"{path}: {m[1]} is not set")
            return env[m[1]]
        return x

    return resolved(raw)


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def build_once(spark: SparkSession, path: str, config: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at the path if it was built from this configuration, else builds it; the hash is part of the path."""
    full = f"{path}/config={config_hash(config)[:16]}"
    if not _exists(spark, full):
        build().write.mode("overwrite").parquet(full)
    return spark.read.parquet(full)


def with_retry(pull: Callable[[], object], attempts: int = 5, base: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """Calls until it works, waiting base, 2 base, 4 base, ... seconds with some jitter in between."""
    for k in range(attempts):
        try:
            return pull()
        except Exception:
            if k == attempts - 1:
                raise
            sleep(base * 2**k * (1 + random.random() / 10))
    return None


def pull_or_split(pull: Callable[[list], list], slots: list) -> list:
    """One pull for all slots; where it fails, one for each half."""
    try:
        return pull(slots)
    except Exception:
        if len(slots) <= 1:
            raise
        half = len(slots) // 2
        return pull_or_split(pull, slots[:half]) + pull_or_split(pull, slots[half:])


def flatten_payload(df: DataFrame, keys: list[str], stats: str, categories: list[str]) -> DataFrame:
    """An array of (category, stat) as one column for each category, in snake case."""
    from ..functions.exprs import camel_to_snake

    long = df.select(*keys, F.explode_outer(stats).alias("__s")).select(*keys, "__s.category", "__s.stat")
    wide = long.groupBy(*keys).pivot("category", categories).agg(F.first("stat", ignorenulls=True))
    return wide.withColumnsRenamed({c: camel_to_snake(c) for c in categories})
