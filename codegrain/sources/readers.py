"""Readers of the engine's external formats.  All are lazy scans; schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType()), T.StructField("class", T.StringType()), T.StructField("confidence", T.DoubleType())])
ITEM = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("split", "family", "source", "sourceName", "path")] + [T.StructField("sourceLabels", T.ArrayType(SPAN))]
)
POPULARITY = T.StructType([T.StructField("languages", T.ArrayType(T.StructType([T.StructField("family", T.StringType()), T.StructField("pushers", T.LongType()), T.StructField("supplemental", T.BooleanType())])))])


def raw_folder(spark: SparkSession, root: str) -> DataFrame:
    """Files under ``root/<language>/``: ``path, lang, text``; what is not UTF-8 is left out."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    lang = F.element_at(F.split("path", "/"), F.lit(-2))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return df.where(text.isNotNull()).select("path", lang.alias("lang"), F.col("content").cast("string").alias("text"))


def label_shards(spark: SparkSession, pattern: str) -> DataFrame:
    """Lines ``path<TAB>code``: split at the first tab, lines without a code dropped; ``shard`` is the file name.

    ``lang`` is the folder of the path.
    """
    lines = spark.read.text(pattern).select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("shard"))
    path = F.substring_index("value", "\t", 1)
    code = F.when(F.instr("value", "\t") > 0, F.expr("substring(value, instr(value, '\t') + 1)"))
    out = lines.select("shard", path.alias("path"), code.alias("rle")).where("rle IS NOT NULL AND rle <> ''")
    parts = F.split("path", r"[/\\]")
    return out.withColumn("lang", F.when(F.size(parts) >= 2, F.element_at(parts, F.lit(-2))))


def items(spark: SparkSession, pattern: str, splits: list[str]) -> DataFrame:
    """Labelled items from (compressed) JSON lines, of the given splits."""
    return spark.read.schema(ITEM).json(pattern).where(F.col("split").isin(*splits))


def denylist(spark: SparkSession, pattern: str) -> DataFrame:
    """Hex digests, one per line, blank lines ignored."""
    return spark.read.text(pattern).select(F.lower(F.trim("value")).alias("digest")).where("digest <> ''").distinct()


def popularity(spark: SparkSession, path: str, top: int = 25) -> DataFrame:
    """``family, pushers`` of the leading families in the file's order, supplemental ones left out."""
    one = spark.read.schema(POPULARITY).option("multiLine", "true").json(path)
    rows = one.select(F.posexplode("languages").alias("ix", "l")).select("ix", "l.*").where("NOT coalesce(supplemental, false)")
    return rows.orderBy("ix").limit(top).select("family", "pushers")


def split_cache(spark: SparkSession, path: str, split: str, keys: list[str] | None = None) -> DataFrame:
    """Cached windows of one split; only the asked columns are read, only that split's folder is scanned."""
    df = spark.read.parquet(path).where(F.col("split") == split)
    return df.select(*keys) if keys else df
