"""Writers: routed JSON lines, manifests, staged publishing, rejects, review sheets."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered


class PublishError(RuntimeError):
    """A release can't be published as asked."""


def write_routed(df: DataFrame, path: str, by: str) -> None:
    """One folder of JSON lines for each value of ``by`` (a split, a route), written in one pass."""
    df.write.partitionBy(by).mode("errorifexists").option("ignoreNullFields", False).json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, sha256 of every data file under ``path``; hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_replace("path", "^.*/(?=[^/]+/?[^/]*$)", "").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def publish(df: DataFrame, path: str, by: str | None = None) -> dict:
    """Write beside ``path``, add the manifest, then rename: readers see all of a release or nothing of it.

    The manifest (rows, files, bytes and one digest over the file digests) is
    the last file written. A path that is there already is refused.
    """
    spark = df.sparkSession
    fs, target = _hadoop(spark, path)
    if fs.exists(target):
        raise PublishError(f"{path} exists")
    stage = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(f"{stage}/data")
    # One row a file comes to the driver; releases have thousands.
    files = sorted((r["file"], r["bytes"], r["sha256"]) for r in manifest(spark, f"{stage}/data").collect())
    digest = spark.range(1).select(F.sha2(F.lit("\n".join(f[2] for f in files)), 256)).first()[0]
    about = {"rows": spark.read.parquet(f"{stage}/data").count(), "files": len(files), "bytes": sum(f[1] for f in files), "digest": digest}
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.text(f"{stage}/manifest")
    if not fs.rename(_hadoop(spark, stage)[1], target):
        raise PublishError(f"{path} can't be put in place")
    return about


def split_valid(df: DataFrame, problems: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sound records, rejects with their problems, and how many records each problem has."""
    marked = df.withColumn("problems", problems)
    rejects = marked.where(F.size("problems") > 0)
    counts = rejects.select(F.explode("problems").alias("problem")).groupBy("problem").agg(F.count("*").alias("records"))
    return marked.where(F.size("problems") == 0).drop("problems"), rejects, counts


#: What a spreadsheet would take for a formula.
_FORMULA = r"^[=+\-@\t\r]"


def neutral(c: Column) -> Column:
    """Cell text that no spreadsheet runs: an apostrophe before what looks like a formula."""
    return F.when(c.rlike(_FORMULA), F.concat(F.lit("'"), c)).otherwise(c)


def review_sheets(sample: DataFrame, order: str, shown: list[str], hidden: list[str], prefix: str = "R") -> tuple[DataFrame, DataFrame]:
    """A blind sheet (sample_id and the shown columns) and its key (sample_id and the hidden ones), ids in the order of a unique column."""
    rows = numbered(sample, order).withColumn("sample_id", F.format_string(f"{prefix}%05d", "nth"))
    return rows.select("sample_id", *[neutral(F.col(c)).alias(c) for c in shown]), rows.select("sample_id", *hidden)
