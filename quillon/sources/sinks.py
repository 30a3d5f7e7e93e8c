"""Writers: manifests, tables, logs, nested records and status rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import cut, release
from quillon.sources.files import MANIFEST_SCHEMA

MANIFEST_COLUMNS = tuple(part.split()[0] for part in MANIFEST_SCHEMA.split(", "))


def save_manifest(df: DataFrame, path: str) -> None:
    """The manifest columns in their order, sorted by range of sample_id, as CSV files."""
    missing = [c for c in MANIFEST_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError("manifest lacks " + ", ".join(missing))
    df.select(*MANIFEST_COLUMNS).orderBy("sample_id").write.mode("overwrite").csv(path, header=True)


def save_table(df: DataFrame, path: str, partition_by: list[str] | None = None, form: str = "parquet") -> None:
    """A table as Parquet, or as CSV files with a header each; CSV takes no arrays or structs."""
    writer = df.write.mode("overwrite")
    if form == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).format(form).save(path)


def append_rows(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Rows added to a table; a CSV reader skips the header of every file, so each name is a row once or never."""
    writer = df.write.mode("append")
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)


def rewrite(df: DataFrame, path: str) -> None:
    """Write ``df`` over the table at ``path`` even if it was read from there: it is materialised elsewhere first."""
    held = cut(df)
    save_table(held, path)
    release(held)


def update_table(spark: SparkSession, path: str, key: str, value: str, changes: dict) -> None:
    """Set the columns of ``changes`` on the rows whose key is ``value``, in place; a missing key raises."""
    table = spark.read.parquet(path)
    if table.where(F.col(key) == value).isEmpty():
        raise ValueError(f"no row with {key} = {value}")
    rewrite(updated(table, key, value, changes), path)


def save_once(df: DataFrame, path: str) -> bool:
    """Write unless a finished table is there already; True if it was written."""
    jvm = df.sparkSession.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if marker.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).exists(marker):
        return False
    save_table(df, path)
    return True


def stable_json(df: DataFrame, limit: int = 10_000) -> str:
    """A small result as JSON with sorted keys; more than ``limit`` rows raise."""
    rows = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; write a table instead")
    return json.dumps(rows, sort_keys=True, indent=2, default=str) + "\n"


def nested_records(df: DataFrame, key: str, fields: list[str], forbidden: tuple[str, ...] = ()) -> DataFrame:
    """(key, record): one JSON object a key with an array of its rows; forbidden fields raise."""
    bad = sorted(set(fields) & set(forbidden))
    if bad:
        raise ValueError("fields may not be written: " + ", ".join(bad))
    grouped = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))
    return grouped.select(key, F.to_json(F.struct(key, "rows")).alias("record"))


def updated(df: DataFrame, key: str, value: str, changes: dict) -> DataFrame:
    """``df`` with the columns of ``changes`` set on the rows whose key is ``value``."""
    for c, v in changes.items():
        df = df.withColumn(c, F.when(F.col(key) == value, F.lit(v)).otherwise(F.col(c)))
    return df


def simple_yaml(value, indent: int = 0) -> str:
    """Nested dicts, lists and scalars as YAML without tags, for configuration-sized values."""
    pad = " " * indent
    if isinstance(value, dict):
        return "".join(f"{pad}{k}:\n{simple_yaml(v, indent + 2)}" if isinstance(v, (dict, list)) else f"{pad}{k}: {_scalar(v)}\n" for k, v in value.items())
    if isinstance(value, list):
        return "".join(f"{pad}-\n{simple_yaml(v, indent + 2)}" if isinstance(v, (dict, list)) else f"{pad}- {_scalar(v)}\n" for v in value)
    return f"{pad}{_scalar(value)}\n"


def _scalar(v) -> str:
    return "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v)
