"""Structured Streaming forms: lexing is per document and stateless, counts are kept per language."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codegrain.functions.featurize import token_rows


def stream_files(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_tokens(df: DataFrame, id_col: str, text_col: str, layout: str, fields: list[str], *carry: str) -> DataFrame:
    """Token rows of a stream: the same expression as for a table."""
    return token_rows(df, id_col, text_col, layout, fields, *carry)


def language_counts(tokens: DataFrame, lang: str = "lang") -> DataFrame:
    """Running counts of words and symbols per language (update mode): map-side combined, one row of state each."""
    kind = F.col("kind")
    return tokens.groupBy(lang).agg(F.sum((kind == 0).cast("long")).alias("words"), F.sum((kind == 3).cast("long")).alias("symbols"), F.count("*").alias("tokens"))


def windowed_counts(events: DataFrame, ts: str, key: str, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts per key and tumbling window; events later than ``late`` are dropped by the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length), key).agg(F.count("*").alias("n")).select("window.start", "window.end", key, "n")


def capped(df: DataFrame, fingerprint: str, most: int = 3) -> DataFrame:
    """The first ``most`` rows of each fingerprint over the life of the stream; state is one count each."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def keep(key: tuple, batches, state: GroupState):  # noqa: ANN001, ANN202
        seen = state.get[0] if state.exists else 0
        for pdf in batches:
            room = max(most - seen, 0)
            seen += len(pdf)
            yield pdf.head(room)
        state.update((min(seen, most),))

    return df.groupBy(fingerprint).applyInPandasWithState(keep, df.schema, "seen int", "append", GroupStateTimeout.NoTimeout)


def latest_wins(path: str, key: str, version: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that keeps the newest version per key of each batch, written per batch id.

    Writing a batch again replaces its own folder, so replays after a failure change nothing.  Batches are merged when
    they are read (:func:`read_latest`): an older version that comes late does not replace a newer one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        cols = [c for c in batch.columns if c != key]
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*cols), version).alias("x")).select(key, *[f"x.{c}" for c in cols])
        newest.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_latest(spark: SparkSession, path: str, key: str, version: str) -> DataFrame:
    """The newest version of each key over all batches of a :func:`latest_wins` sink; ties go to the later batch."""
    rows = spark.read.parquet(path)
    cols = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(version, "batch")).alias("x")).select(key, *[f"x.{c}" for c in cols])
