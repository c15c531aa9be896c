"""Problem 1: near-duplicate texts by adaptive multi-match prefixes.

Each text's prefix is lengthened by estimated candidate cost; a pair becomes a candidate only if it
shares as many prefix shingles as the lengthening (and the sizes of both) ask for, and is then verified
on the full shingle sets.  The join is exact: no link of the threshold or more is lost.

Defined results: null texts and texts under the least number of words belong to no link; rows of one id
count once (the latest delivered); equal texts are one class; empty tables give empty results; columns
of the input other than those named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrain.llm.similarity import meetings, postings, prefixes, representatives, spread_postings, survey, verify
from codegrain.operators.durable import durable
from codegrain.operators.graph import connected_components
from codegrain.operators.ordered import salted_join, self_pairs

PER_BLOCK = 2_000  # members of one class that meet in one task


@dataclass(frozen=True)
class NearDuplicates:
    """``texts (doc, rep, fp, n_words)`` and the verified ``links (a, b, n_a, n_b, n_both)`` of representatives."""

    texts: DataFrame
    links: DataFrame


def near_duplicates(
    df: DataFrame, id_col: str, text_col: str, version_col: str | None = None, k: int = 5, num: int = 4, den: int = 5, least_words: int = 1
) -> NearDuplicates:
    """All pairs of different texts whose k-word shingle sets have a Jaccard similarity of num/den or more."""
    texts, sketch = survey(df, id_col, text_col, version_col, k, "neardup")
    texts = texts.where(F.col("n_words") >= least_words)
    docs = representatives(prefixes(df, id_col, text_col, sketch, k, num, den, least_words, adaptive=True), texts)
    post = spread_postings(postings(docs), texts, num, den)
    candidates = durable(meetings(post, post, num, den, "l.doc < r.doc"), "neardup-candidates")
    links = durable(verify(candidates, df, texts, id_col, text_col, k, num, den), "neardup-links")
    return NearDuplicates(texts, links)


def expand_pairs(texts: DataFrame, links: DataFrame, left_where: str = "true", right_where: str = "true") -> DataFrame:
    """Pairs ``(file_id_a, file_id_b)`` of ids, smaller first, of linked or equal texts.

    A pair has one id that satisfies ``left_where`` and another that satisfies ``right_where`` (conditions
    on columns of ``texts``).
    """
    symmetric = left_where == right_where
    both = links.select("a", "b") if symmetric else links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # members of large classes are spread: a link is repeated once per block of its ends' members
    sizes = texts.groupBy("rep").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / F.lit(PER_BLOCK)).cast("int"))
    ends = both.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("w")).join(sizes, "rep").select("rep", "w", "parts")
    place = lambda n: F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(n)
    spread = salted_join(both, ends.withColumnRenamed("rep", "a"), "a", "w").select("a", "b", place("pa"))
    spread = salted_join(spread, ends.withColumnRenamed("rep", "b"), "b", "w").select("a", "b", "pa", place("pb"))
    # only classes with a link, in rows that know their block
    linked = salted_join(texts, ends.join(sizes.select("rep", "n"), "rep").select("rep", "n", "parts"), "rep", "n")
    linked = linked.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    left = linked.where(left_where).select(F.col("doc").alias("x"), F.col("rep").alias("a"), F.col("block").alias("pa"))
    right = linked.where(right_where).select(F.col("doc").alias("y"), F.col("rep").alias("b"), F.col("block").alias("pb"))
    across = spread.join(left, ["a", "pa"]).join(right, ["b", "pb"]).select("x", "y")
    either = "(l.one AND r.two) OR (l.two AND r.one)"
    rows = texts.select("doc", "rep", F.expr(left_where).alias("one"), F.expr(right_where).alias("two"))
    within = self_pairs(rows, "rep", "doc", either, PER_BLOCK).select(F.col("l.doc").alias("x"), F.col("r.doc").alias("y"))
    every = across.union(within)
    return every.select(F.least("x", "y").alias("file_id_a"), F.greatest("x", "y").alias("file_id_b")).distinct()


def groups(found: NearDuplicates) -> DataFrame:
    """One row per id: ``doc, rep`` (class of equal text), ``group_id`` (least id reachable by links), ``n_links``, ``n_copies``."""
    links = found.links
    comp = connected_components(links, "a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    copies = found.texts.groupBy("rep").agg(F.count("*").alias("n_copies"))
    classes = copies.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").join(degree, "rep", "left")
    out = salted_join(found.texts.select("doc", "rep"), classes.withColumn("w", F.col("n_copies")), "rep", "w")
    return out.select("doc", "rep", F.coalesce("component", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
