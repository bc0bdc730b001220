"""Reading and writing: delimited bars, Parquet, JSON reports and artifacts, models."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import BLOCK, with_block

FORMATS = {".csv": "csv", ".tsv": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc"}

#: The column by which stored series are partitioned.
YEAR = "_year"

BAR = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        *[T.StructField(n, T.FloatType()) for n in ("open", "high", "low", "close")],
        T.StructField("tickvol", T.LongType()),
        T.StructField("vol", T.LongType()),
        T.StructField("spread", T.IntegerType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _format(path: str) -> str:
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in FORMATS:
        raise ValueError(f"no format is known for {path}")
    return FORMATS[suffix]


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read by extension. CSV has a header, and strings unless a schema is given."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    kind = _format(path)
    if kind == "csv":
        reader = reader.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",")
    return reader.format(kind).load(path)


def write_table(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    kind = _format(path)
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def write_series(df: DataFrame, name: str, by: Sequence[str] = (), buckets: int = 64, ts: str = "timestamp") -> None:
    """A table of the session's warehouse that later windows and alignments read without an exchange: bucketed by symbol
    and block of time, in order of time inside a file, and partitioned by year, which year and date ranges prune."""
    dealt = with_block(df, by, ts).withColumn(YEAR, F.year(ts)).repartition(buckets, *by, BLOCK)
    dealt.write.mode("overwrite").partitionBy(YEAR).bucketBy(buckets, *by, BLOCK).sortBy(*by, BLOCK, ts).saveAsTable(name)


def read_series(spark: SparkSession, name: str, years: Iterable[int] | None = None, start: str | None = None, end: str | None = None, ts: str = "timestamp") -> DataFrame:
    """Rows of a table that write_series wrote, in its blocks: of some years, or of start <= time <= end. Only the years
    asked for are read."""
    rows = spark.table(name)
    if years is not None:
        rows = rows.where(F.col(YEAR).isin(*years))
    for bound, keeps in ((start, lambda c, b: c >= b), (end, lambda c, b: c <= b)):
        if bound is not None:
            bound = F.lit(bound).cast("timestamp_ntz")
            rows = rows.where(keeps(F.col(ts), bound) & keeps(F.col(YEAR), F.year(bound)))
    return rows.drop(YEAR)


def read_raw_bars(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Tab-separated files of raw bars, all strings, with the file, its size and an ordinal of the ingest order.

    Raises if no file matches the pattern. Header names lose their angle brackets and are lower-cased.
    """
    try:
        raw = spark.read.option("sep", "\t").option("header", True).option("pathGlobFilter", pattern).csv(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no {pattern} in {path}") from e
    names = [n.strip().replace("<", "").replace(">", "").lower() for n in raw.columns]
    meta = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size"))
    return meta.toDF(*names, "file_path", "file_size").withColumn("ordinal", F.monotonically_increasing_id())


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def write_report(report: DataFrame, path: str) -> None:
    """A report of one row as JSON text."""
    report.select(F.to_json(F.struct("*"))).coalesce(1).write.mode("overwrite").text(path)


def read_artifact(spark: SparkSession, path: str) -> dict:
    """A JSON document of any layout, by a path that Spark can open; raises if it is missing."""
    rows = spark.read.option("wholetext", True).text(path).take(2)
    if len(rows) != 1:
        raise ValueError(f"{path} is not one document")
    return json.loads(rows[0][0])


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """(regime, learner, weight) of a document that maps regimes to learners' weights."""
    document = read_artifact(spark, path)
    rows = [(r, k, float(w)) for r, own in document.items() for k, w in own.items()]
    return spark.createDataFrame(rows, "regime string, learner string, weight double")


def head_sample(df: DataFrame, rows: int = 5) -> DataFrame:
    """A few rows as they come, for a first look; reads no more than it must."""
    return df.limit(rows)


def save_model(model, path: str) -> None:
    """A fitted pipeline, or any model that saves itself."""
    if hasattr(model, "write"):
        model.write().overwrite().save(path)
    else:
        model.save(path)


def load_model(path: str, kind=None):
    """A pipeline; of another kind, by its own load."""
    from pyspark.ml import PipelineModel

    return (kind or PipelineModel).load(path)
