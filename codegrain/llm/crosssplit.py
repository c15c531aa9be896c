"""Problem 5: texts of the evaluation splits that stand, exactly or almost, in the training split.

An exact prefix-filter bipartite join on rare shingles: prefixes of evaluation texts are the index, a
bitmap of their shingles keeps all others of the training prefixes from being moved, the rest probe it under the length and position filters, and what is left is verified on full
shingle sets.

Defined results: the split is read without regard to case and outer blanks; rows without a split, or of
another one, are on neither side; null and too short texts match nothing; ids count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrain.llm.neardup import expand_pairs
from codegrain.llm.similarity import bitmap, meetings, postings, prefixes, representatives, spread_postings, survey, verify
from codegrain.operators.durable import durable
from codegrain.operators.ordered import salted_by, salted_join

EVAL = ("val", "test")


def probing(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Prefix rows of ``train`` without the shingles that no prefix of ``evaluation`` has (but for a few), their positions in ``places``."""
    marks, bits = bitmap(evaluation.select(F.explode("tokens").alias("token")), "token")
    shared = train.sparkSession.sparkContext.broadcast(marks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap_ = np.frombuffer(shared.value, np.int64)
        for b in batches:
            slots, tokens = b.column("slots").combine_chunks() if isinstance(b.column("slots"), pa.ChunkedArray) else b.column("slots"), b.column("tokens")
            slot = slots.flatten().to_numpy()
            hit = ((bitmap_[slot >> 6] >> (slot & 63)) & 1).astype(bool)
            bounds = np.concatenate(([0], np.cumsum(np.diff(tokens.offsets.to_numpy()))))
            at = np.flatnonzero(hit)
            row = np.searchsorted(bounds, at, "right") - 1
            ends = pa.array(np.searchsorted(row, np.arange(len(bounds))), pa.int32())
            pick = lambda c: pa.ListArray.from_arrays(ends, c)
            keep = pa.array(at)
            cols = [b.column(c) for c in ("doc", "size", "level")] + [pick(tokens.flatten().take(keep)), pick(b.column("parts").flatten().take(keep)), pick(pa.array((at - bounds[row]).astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "size", "level", "tokens", "parts", "places"])

    slot = F.transform("tokens", lambda t: F.pmod(F.xxhash64(t), F.lit(1 << bits)))
    return train.withColumn("slots", slot).mapInArrow(work, "doc long, size int, level int, tokens array<long>, parts array<int>, places array<int>")


@dataclass(frozen=True)
class CrossSplit:
    """``texts (doc, rep, n_words, split, …)``, ``links`` of representatives, ``pairs (file_id_a, file_id_b)``."""

    texts: DataFrame
    links: DataFrame
    pairs: DataFrame


def cross_split(
    df: DataFrame, id_col: str, text_col: str, split_col: str, version_col: str | None = None, k: int = 5, num: int = 4, den: int = 5, least_words: int = 1
) -> CrossSplit:
    """Pairs of ids, one in train and one in val or test, with shingle similarity num/den or more."""
    version = F.col(version_col) if version_col else F.lit(0)
    side = F.lower(F.trim(F.col(split_col)))
    sides = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc")).agg(F.max_by(side, F.struct(version, side)).alias("split"))
    texts, sketch = survey(df, id_col, text_col, version_col, k, "crosssplit")
    texts = texts.where(F.col("n_words") >= least_words).join(sides, "doc")
    texts = texts.where(F.col("split").isin("train", *EVAL))
    # the representative of a class stands for its members of either side, whatever its own split
    of_class = texts.groupBy("fp").agg(F.min("doc").alias("rep"), F.max(F.col("split") == "train").alias("in_train"), F.max(F.col("split") != "train").alias("in_eval"), F.count("*").alias("n"))
    texts = durable(salted_join(texts.drop("rep"), of_class, "fp", "n"), "crosssplit-texts")
    docs = representatives(prefixes(df, id_col, text_col, sketch, k, num, den, least_words, adaptive=False), texts, "in_train", "in_eval")
    docs = durable(docs, "crosssplit-prefixes")
    # the index: training shingles that stand in no evaluation prefix meet nothing and stay where they are
    probes = docs.where("in_train").select("doc", "size", "level", "tokens", "parts")
    index = postings(docs.where("in_eval"), positions=True)
    probed = postings(probing(probes, docs.where("in_eval")), positions=True)
    met = meetings(spread_postings(probed, texts, num, den), spread_postings(index, texts, num, den), num, den, "l.doc <> r.doc")
    candidates = durable(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "crosssplit-candidates")
    links = durable(verify(candidates, df, texts, id_col, text_col, k, num, den), "crosssplit-links")
    return CrossSplit(texts, links, expand_pairs(texts, links, "split = 'train'", "split <> 'train'"))


def report(found: CrossSplit, sources: DataFrame) -> DataFrame:
    """Overlaps per evaluation split and the columns of ``sources (doc, …)`` of the evaluation row."""
    keys = [c for c in sources.columns if c != "doc"]
    split = found.texts.select("doc", "split")
    ends = found.pairs.select(F.explode(F.array(F.struct(F.col("file_id_a").alias("doc"), F.col("file_id_b").alias("other")), F.struct(F.col("file_id_b").alias("doc"), F.col("file_id_a").alias("other")))).alias("e")).select("e.*")
    # an evaluation row may be in any share of the pairs: its pairs are dealt out
    ends = durable(ends, "overlap-ends")
    about = split.where("split <> 'train'").join(sources, "doc", "left")
    ends = salted_by(ends, about, "doc", ends.groupBy("doc").agg(F.count("*").alias("w")), "w", ends.count())
    return ends.groupBy("split", *keys).agg(F.count("*").alias("n_pairs"), F.countDistinct("doc").alias("n_eval"), F.countDistinct("other").alias("n_train"))
