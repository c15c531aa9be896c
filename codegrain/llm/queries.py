"""Queries of the training-data problems: name -> callable(spark, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codegrain.tables import table


def _counted(df: DataFrame) -> DataFrame:
    """One row of named counts as rows ``check, n``."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("n")) for c in df.columns])).alias("x")).select("x.*")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from codegrain.llm.neardup import expand_pairs, near_duplicates

    found = near_duplicates(_files(spark, d), "file_id", "text", "ingested_at", k=4, num=7, den=10, least_words=30)
    return expand_pairs(found.texts, found.links)


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    from codegrain.llm.neardup import groups, near_duplicates

    found = near_duplicates(_files(spark, d), "file_id", "text", "ingested_at", k=5, num=4, den=5)
    return groups(found).withColumnRenamed("doc", "file_id")


def _overlaps(spark: SparkSession, d: str):
    from codegrain.llm.crosssplit import cross_split

    return cross_split(_files(spark, d), "file_id", "text", "split", "ingested_at", k=4, num=7, den=10, least_words=30)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).pairs


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pieces(spark, d).groupBy("file_id").agg(F.count("*").alias("n")).where("n > 1").select("file_id")


def p2_checks(spark: SparkSession, d: str) -> DataFrame:
    """Properties of the pieces: items, tokens, pieces over the limit, gaps, wrong overlaps, ends weaker than one in reach."""
    from codegrain.operators.durable import durable

    pieces = durable(p2_pieces(spark, d), "piece-checks")
    whole = ["offsets", "block_starts", "seq_len", "overlap"]
    items = table(spark, d, "token_streams").where("file_id IS NOT NULL").groupBy("file_id").agg(F.max_by(F.struct(*whole), "built_at").alias("x")).select("file_id", "x.*")
    items = items.select("file_id", F.array_compact("offsets").alias("o"), F.coalesce(F.array_compact("block_starts"), F.array().cast("array<long>")).alias("b"), F.col("seq_len").alias("limit"), F.least(F.greatest(F.coalesce("overlap", F.lit(0)), F.lit(0)), F.col("seq_len") - 1).alias("over"))
    items = items.where("size(o) > 0").withColumn("base", F.array_min("o")).withColumn("total", F.array_max("o") - F.col("base"))
    met = pieces.join(items, "file_id").withColumn("reach", F.col("tok_from") + F.col("limit"))
    fits = lambda c, last: F.exists(c, lambda p: (p - F.col("base") > F.col("own_from")) & (p - F.col("base") <= F.least("reach", "total")) & ((p - F.col("base") < F.col("total")) | last))
    whole_fits = F.col("total") <= F.col("reach")
    at = lambda c: F.exists(c, lambda p: p - F.col("base") == F.col("tok_to"))
    ends = F.col("tok_to") == F.col("total")
    weak = F.when(ends, False).when(fits("b", F.lit(False)) | whole_fits, ~at("b")).when(fits("o", F.lit(False)), ~(at("o") | at("b"))).otherwise(False)
    w = Window.partitionBy("file_id").orderBy("piece_ix")
    # pieces of one item are few; the window is over an item, not over a frequent key
    met = met.withColumn("gap", F.col("own_from") != F.coalesce(F.lag("tok_to").over(w), F.lit(0)))
    count = lambda c, name: F.sum(c.cast("long")).alias(name)
    return met.agg(
        F.countDistinct("file_id").alias("items"), F.sum(F.col("tok_to") - F.col("own_from")).alias("tokens"), count(F.col("tok_to") - F.col("tok_from") > F.col("limit"), "too_long"),
        count(F.col("gap"), "gaps"), count(F.col("tok_from") != F.greatest(F.col("own_from") - F.col("over"), F.lit(0)), "wrong_overlaps"), count(weak, "weak_ends"),
    )


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    from codegrain.llm.chunking import split_items

    out = split_items(table(spark, d, "token_streams"), "file_id", "offsets", "seq_len", "overlap", "block_starts", "built_at")
    return out.withColumnRenamed("id", "file_id")


def _families(spark: SparkSession, d: str) -> DataFrame:
    from codegrain.llm.splits import families

    return families(_files(spark, d), table(spark, d, "repos"), "file_id", "path", "ingested_at", "split", "lang")


def _canonical_lang(spark: SparkSession, d: str) -> DataFrame:
    """``alias, lang`` of the fixed language table."""
    dim = table(spark, d, "lang_dim")
    names = F.array_union(F.array("lang"), F.coalesce("aliases", F.array().cast("array<string>")))
    return dim.select(F.explode(F.transform(names, F.lower)).alias("alias"), "lang").dropDuplicates(["alias"])


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    from codegrain.llm.splits import assign

    fams = _families(spark, d).withColumn("alias", F.lower(F.trim("lang"))).drop("lang")
    fams = fams.join(F.broadcast(_canonical_lang(spark, d)), "alias", "left").select("doc", "family", "split", F.coalesce("lang", "alias").alias("lang"))
    return assign(fams, "lang", given="split").withColumnRenamed("doc", "file_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Files of the families that the operator brings together, having found them torn."""
    return _assigned(spark, d).where("torn").select("file_id")


def p3_split(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d).select("file_id", "family", F.col("label").alias("lang"), "split")


def p3_checks(spark: SparkSession, d: str) -> DataFrame:
    """Properties of the split: files, files without one, families in several, splits off their quota by
    more than a point and more than the largest family."""
    from codegrain.llm.splits import QUOTAS
    from codegrain.operators.durable import durable

    out = durable(p3_split(spark, d), "split-checks")
    fams = out.where("family IS NOT NULL").groupBy("family").agg(F.min("split").alias("lo"), F.max("split").alias("hi"), F.count("*").alias("n"))
    torn = fams.where("lo < hi").agg(F.count("*").alias("torn"))
    n, largest = out.count(), fams.agg(F.max("n")).first()[0] or 0
    quota = F.create_map(*[F.lit(x) for kv in QUOTAS.items() for x in kv])
    share = out.groupBy("split").agg(F.count("*").alias("n")).withColumn("off", F.abs(F.col("n") - F.element_at(quota, F.col("split")) * F.lit(n / 100)))
    off = share.agg(F.sum((F.col("off") > F.lit(max(n / 100, largest))).cast("long")).alias("off_quota"))
    files = out.agg(F.count("*").alias("files"), F.sum(F.col("split").isNull().cast("long")).alias("without"))
    return _counted(files).union(_counted(torn)).union(_counted(off))


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    return p3_split(spark, d).groupBy("lang", "split").agg(F.count("*").alias("n_files"))


def _origins(spark: SparkSession, d: str) -> DataFrame:
    from codegrain.llm.origin import origins

    return origins(_files(spark, d), "file_id", "path", "text", "lang", "ingested_at")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _origins(spark, d).where("origin IS NOT NULL").select(F.col("doc").alias("file_id"))


def p4_origins(spark: SparkSession, d: str) -> DataFrame:
    return _origins(spark, d).withColumnRenamed("doc", "file_id").select("file_id", "origin", "family", "family_files", "family_projects")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    from codegrain.llm.crosssplit import report

    one = _files(spark, d).groupBy(F.col("file_id").alias("doc")).agg(F.max_by(F.struct("path", "lang"), F.struct("ingested_at", F.xxhash64("path", "lang"))).alias("x"))
    rest = F.regexp_extract("x.path", r"(?i)(?:^|[/\\])raw[/\\]+[^/\\]+[/\\]+(.+)$", 1)
    parts = F.split(rest, r"__|[/\\]")
    repo = F.when(F.size(parts) > 2, F.lower(F.concat_ws("__", F.slice(parts, 1, 2)))).otherwise("?")
    return report(_overlaps(spark, d), one.select("doc", repo.alias("repo"), F.lower(F.trim("x.lang")).alias("lang")))


def _token_counts(spark: SparkSession, d: str, *carry: str) -> DataFrame:
    from codegrain.llm.tokens import token_counts

    return token_counts(table(spark, d, "documents"), "doc_id", "text", *carry, version_col="ingested_at")


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    from codegrain.llm.packing import pack

    out = pack(_token_counts(spark, d), "doc", "n_tokens", (512, 1024, 2048))
    return out.withColumnRenamed("doc", "doc_id")


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """Properties of the containers: overfull ones, holes or overlaps, pieces of documents that would fit whole."""
    from codegrain.operators.durable import durable

    out = durable(p6_containers(spark, d), "container-checks").withColumn("n", F.col("tok_to") - F.col("tok_from"))
    per = out.groupBy("container").agg(F.sum("n").alias("used"), F.max(F.col("place") + F.col("n")).alias("top"), F.max("capacity").alias("most"), F.min("capacity").alias("least"))
    full = per.agg(F.sum(((F.col("top") > F.col("least")) | (F.col("most") != F.col("least"))).cast("long")).alias("overfull"), F.sum((F.col("used") != F.col("top")).cast("long")).alias("with_holes"))
    docs = out.groupBy("doc_id").agg(F.sum("n").alias("n"), F.count("*").alias("pieces")).agg(F.sum(((F.col("n") <= 2048) & (F.col("pieces") > 1)).cast("long")).alias("split_in_vain"))
    return _counted(docs).union(_counted(full))


def _mixture(spark: SparkSession, d: str):
    from codegrain.llm.mixing import mix

    return mix(_token_counts(spark, d, "source"), table(spark, d, "mix_targets"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).docs.withColumnRenamed("doc", "doc_id")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).shares


def p7_shares_full(spark: SparkSession, d: str) -> DataFrame:
    """Shares at a total of all tokens of the target sources: those that cannot follow run short."""
    from codegrain.llm.mixing import mix, source_key
    from codegrain.operators.durable import durable

    targets = table(spark, d, "mix_targets")
    docs = durable(_token_counts(spark, d, "source"), "mix-counts")
    names = [r[0] for r in targets.select(source_key("source")).where("source IS NOT NULL").distinct().collect()]  # fixed: 24 rows
    total = docs.where(source_key("source").isin(names)).agg(F.sum("n_tokens")).first()[0] or 0
    return mix(docs, targets, total_tokens=total).shares


def p7_order(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).order.withColumnRenamed("doc", "doc_id")


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Properties of the mixture: documents, those taken too often, sources off their share by more than their longest document accounts for, positions that do not match the times."""
    from codegrain.operators.durable import durable

    mixed = _mixture(spark, d)
    docs, order = durable(mixed.docs, "mixture-docs"), mixed.order
    most = table(spark, d, "mix_targets").select(F.lower(F.trim("source")).alias("source"), "max_repeats")
    over = docs.join(F.broadcast(most), "source", "left").agg(F.count("*").alias("documents"), F.sum((F.col("times") > F.coalesce("max_repeats", F.lit(0))).cast("long")).alias("too_often"))
    longest = docs.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    shares = mixed.shares.join(longest, "source", "left").na.fill(0, ["longest"]).withColumn("whole", F.sum("taken_tokens").over(Window.partitionBy())).withColumn("slack", F.sum("longest").over(Window.partitionBy()))
    wrong = F.abs(F.col("taken_tokens") - F.col("target_share") * F.col("whole")) > F.col("longest") + F.col("target_share") * F.col("slack") + 1
    off = shares.agg(F.sum(wrong.cast("long")).alias("off_share"))  # one row per target source
    seen = order.groupBy("doc").agg(F.count("*").alias("k"), F.min("position").alias("lo"), F.max("position").alias("hi"))
    odd = docs.where("times > 0").join(seen, "doc", "full").agg(F.sum((~F.col("times").eqNullSafe(F.col("k")) | (F.col("lo") < 0) | (F.col("hi") > 1)).cast("long")).alias("odd_positions"))
    return _counted(over).union(_counted(off)).union(_counted(odd))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Properties of the forms: documents, forms that are not their own form."""
    from codegrain.llm.confusables import normalized

    forms = normalized(table(spark, d, "documents"), "doc_id", "text", "ingested_at").where("form IS NOT NULL")
    again = normalized(forms.select("doc", F.col("form").alias("text")), "doc", "text", keep_text=False)
    one = forms.agg(F.count("*").alias("documents"))
    return _counted(one).union(_counted(again.agg(F.sum(F.col("changed").cast("long")).alias("unstable"))))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from codegrain.llm.confusables import look_alikes, normalized

    return look_alikes(normalized(table(spark, d, "documents"), "doc_id", "text", "ingested_at", keep_text=False))


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    from codegrain.llm.confusables import normalized

    out = normalized(table(spark, d, "documents"), "doc_id", "text", "ingested_at")
    return out.select(F.col("doc").alias("doc_id"), "form", "changed", "has_visible", "n_mixed", "n_whole")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from codegrain.llm.sql import SQL

    return SQL
