"""Reading and writing files."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession


def read_data(spark: SparkSession, path: str) -> DataFrame:
    """By name: `.csv`, `.json` (one array), `.jsonl` (a record a line), `.parquet`, each also ending in `.gz`."""
    name = PurePosixPath(path).name.lower().removesuffix(".gz")
    if name.endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"')
    if name.endswith((".json", ".jsonl")):
        return spark.read.json(path, multiLine=name.endswith(".json"))
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"unknown kind of file: {path}")


def from_records(spark: SparkSession, data, schema: str | None = None) -> DataFrame:
    """A frame as it is, or rows from a list of dicts, a dict of lists or a pandas frame."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, dict):
        data = [dict(zip(data, row, strict=True)) for row in zip(*data.values(), strict=True)]
    return spark.createDataFrame(data, schema) if schema else spark.createDataFrame(data)


def free_path(spark: SparkSession, path: str) -> str:
    """The path, or the first of `path (1)`, `path (2)`... that does not exist."""
    jvm, k, stem = spark.sparkContext._jvm, 0, path
    while True:
        target = jvm.org.apache.hadoop.fs.Path(stem)
        if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            return stem
        k += 1
        stem = f"{path} ({k})"


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: str | None = None, numbered: bool = False, single: bool = False) -> str:
    """Write without overwriting: an existing path is an error, or gets a number. Reports may go to a single file."""
    path = free_path(df.sparkSession, path) if numbered else path
    writer = (df.coalesce(1) if single else df).write.mode("errorifexists")
    writer = writer.partitionBy(by) if by else writer
    writer.csv(path, header=True) if kind == "csv" else writer.format(kind).save(path)
    return path


def write_features(tables: dict[str, DataFrame], folder: str, name: str, kind: str = "parquet") -> dict[str, str]:
    """Feature tables as `NAME_KIND` under a folder, numbered where the name is taken; gives the paths."""
    return {k: write_table(t, f"{folder}/{name}_{k}", kind, numbered=True) for k, t in tables.items()}


def write_split(df: DataFrame, folder: str, split_col: str = "split", name: str = "", kind: str = "parquet") -> dict[str, str]:
    """The parts of a split table as `PARTNAME` (`train`, `test`) without the split column; gives the paths."""
    parts = sorted(r[0] for r in df.select(split_col).distinct().where(f"`{split_col}` is not null").limit(1001).collect())
    if len(parts) > 1000:
        raise ValueError("more than 1000 parts")
    return {p: write_table(df.where(df[split_col] == p).drop(split_col), f"{folder}/{p}{name}", kind, numbered=True) for p in parts}


def write_reports(reports: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Reports (cross-validation, external validation, shapes, comparisons of methods) as single CSV files by name."""
    return {k: write_table(t, f"{folder}/{k}", "csv", numbered=True, single=True) for k, t in reports.items()}
