"""Plug-ins: engines that predict classes, functions that label texts, and checks of both.

An engine's prediction of a text is counted against a reference where the text is read; a language that an
engine does not support counts as nothing hit of all its visible characters.  A labelling function returns
pieces of a text with their classes; labels whose pieces do not make up the text are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegrain.functions.labels import encode_rle


@dataclass(frozen=True)
class Engine:
    """``supports`` tells of a language column whether the engine knows it; ``counts`` gives ``id, lang, hit, total``."""

    name: str
    supports: Callable[[Column], Column]
    counts: Callable[[DataFrame], DataFrame]


def compare_engines(df: DataFrame, id_col: str, lang_col: str, visible: Column, engines: list[Engine]) -> DataFrame:
    """``engine, lang, hit, total`` per language; ``visible`` counts a text's characters where an engine has no prediction.

    Texts delivered twice count once; a null language is supported if the engine's ``supports`` says so of null.
    """
    out = None
    for e in engines:
        known = F.coalesce(e.supports(F.col(lang_col)), F.lit(False))
        some = e.counts(df.where(known)).groupBy(id_col, lang_col).agg(F.max("hit").alias("hit"), F.max("total").alias("total"))
        none = df.where(~known).select(id_col, lang_col, F.lit(0).cast("long").alias("hit"), visible.cast("long").alias("total"))
        none = none.groupBy(id_col, lang_col).agg(F.max("hit").alias("hit"), F.max("total").alias("total"))
        rows = some.union(none).groupBy(lang_col).agg(F.sum("hit").alias("hit"), F.sum("total").alias("total"))
        rows = rows.select(F.lit(e.name).alias("engine"), F.col(lang_col), "hit", "total")
        out = rows if out is None else out.union(rows)
    return out


LabelFn = Callable[[str, "str | None"], "list[tuple[str, int]] | None"]


def label_texts(df: DataFrame, id_col: str, text_col: str, lang_col: str, first: LabelFn, fallback: LabelFn | None = None) -> DataFrame:
    """``id, engine, rle``: labels by ``first``, else by ``fallback``; null labels are dropped texts.

    A function returns the pieces (content, class) of a text in order, or None if it cannot; one that raises counts
    as one that cannot.  Pieces that do not make up the whole text drop it.  Null texts are dropped.
    """

    def one(text: str | None, lang: str | None) -> tuple[str | None, str | None]:
        for name, fn in (("first", first), ("fallback", fallback)):
            if text is None or fn is None:
                continue
            try:
                pieces = fn(text, lang)
            except Exception:  # noqa: BLE001  (of the plug-in)
                pieces = None
            if pieces is None:
                continue
            if "".join(p for p, _ in pieces) != text:
                return name, None
            pieces = [p for p in pieces if p[0]]
            return name, encode_rle(np.array([c for _, c in pieces], np.int64), np.array([len(p) for p, _ in pieces], np.int64))
        return None, None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [one(t, x) for t, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in found], pa.string()), pa.array([r for _, r in found], pa.string())], names=[id_col, "engine", "rle"])

    src = df.select(id_col, F.col(text_col), F.col(lang_col))
    return src.mapInArrow(work, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, engine string, rle string")


def resync(text: str, parts: list[str]) -> list[int]:
    """Start of each part in the text: the next place where it stands; ends at the first that stands nowhere ahead.

    Empty parts are skipped; behind a part one line end may be stepped over.
    """
    at, out = 0, []
    for p in parts:
        if not p:
            continue
        if not text.startswith(p, at):
            at = text.find(p, at)
            if at < 0:
                break
        out.append(at)
        at += len(p)
    return out


def resynced(df: DataFrame, id_col: str, text_col: str, parts_col: str) -> DataFrame:
    """``id, starts`` of the parts of each text; null texts and null parts give none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [resync(t or "", [p for p in ps or [] if p]) for t, ps in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], names=[id_col, "starts"])

    src = df.select(id_col, F.col(text_col), F.col(parts_col))
    return src.mapInArrow(work, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, starts array<long>")


def fixture_path(path: Column, least: int, place: int, folder: tuple[str, ...], endings: tuple[str, ...] = (), not_endings: tuple[str, ...] = ()) -> Column:
    """Whether a path has at least ``least`` parts, one of ``folder`` at ``place`` (from 1), and a wanted ending."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    ok = (F.size(parts) >= least) & F.get(parts, F.lit(place - 1)).isin(*folder)
    for e in not_endings:
        ok = ok & ~F.endswith(path, F.lit(e))
    if endings:
        any_ = F.lit(False)
        for e in endings:
            any_ = any_ | F.endswith(path, F.lit(e))
        ok = ok & any_
    return ok


def fixture_text(text: Column) -> Column:
    """Whether a text is of 1 to 400,000 bytes, without NUL and not blank."""
    return F.octet_length(text).between(1, 400_000) & ~text.contains("\x00") & text.rlike(r"\S")


def clean_name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"[^A-Za-z0-9_.-]+", "_"), r"^_+|_+$", "")


def resumed(df: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], path: str, made_for: str, buckets: int = 64) -> DataFrame:
    """``work(df)``, made bucket by bucket of hashed ``key`` into ``path`` and taken up where it stopped.

    A bucket is a folder that stands whole or not at all (Spark's commit), so a run after a failure makes the missing
    ones.  The cache names the data set it was made for (a digest, say); another one is an error.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    note = f"{path}/made_for"
    if fs.exists(at(f"{note}/_SUCCESS")):
        old = spark.read.text(note).first()[0]
        if old != f"{made_for}:{buckets}":
            raise ValueError(f"the cache at {path} was made for {old}")
    else:
        spark.createDataFrame([(f"{made_for}:{buckets}",)], "value string").coalesce(1).write.mode("overwrite").text(note)
    for b in range(buckets):
        if not fs.exists(at(f"{path}/bucket={b}/_SUCCESS")):
            work(df.where(F.pmod(F.xxhash64(key), F.lit(buckets)) == b)).write.mode("overwrite").parquet(f"{path}/bucket={b}")
    return spark.read.option("basePath", path).parquet(*[f"{path}/bucket={b}" for b in range(buckets)]).drop("bucket")


def reference_cases(df: DataFrame, id_col: str, name: Column, code: Column, classes: Column) -> DataFrame:
    """``id, line``: a test case of each text as one JSON line with name, code and classes."""
    return df.select(id_col, F.to_json(F.struct(name.alias("name"), code.alias("code"), classes.alias("classes"))).alias("line"))


