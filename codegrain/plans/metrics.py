"""Queries of the evaluation operators (A01 to A25) and the ordered operators on labels.

Gold is the rule class of a token, the prediction its class by kind alone; both follow from the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codegrain import dims
from codegrain.functions.labels import aligned_counts, boundary_counts, construct_counts, depth_counts, raw_counts, rle_length, scored_counts
from codegrain.functions.lexing import CLASSES
from codegrain.operators.durable import durable
from codegrain.plans.common import SQL_FILES, SQL_GOLD, file_values, files, once, per_file
from codegrain.plans.labels import SQL_LABELLED, labelled, labelled_texts
from codegrain.tables import table

S = SparkSession
TOP = 25
CONSTRUCT = 512
UNDERFILLED = 300_000
#: What JavaScript's blank class holds.
JS_BLANK = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def confusion(s: S, d: str, *carry: str) -> DataFrame:
    """Counts per gold and predicted class, each file once."""
    keys = [*carry, "gold", "pred"]
    rows = once(scored_counts(files(s, d), "text", ["gold", "pred"], "file_id", *carry), keys, "n", "chars")
    out = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    return out.withColumns({k: F.col(k).cast("int") for k in ("gold", "pred")})


def hits(s: S, d: str) -> DataFrame:
    """``lang, hit, total`` of canonical languages."""
    c = confusion(s, d, "lang").groupBy("lang").agg(F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"), F.sum("n").alias("total"))
    return c.where("lang IS NOT NULL")


def weights(s: S, d: str) -> DataFrame:
    """``lang, weight`` of the language table: shares (tail share where none), scaled to 1."""
    dim = table(s, d, "lang_dim").select("lang", F.coalesce("pusher_share", F.lit(0.25)).alias("raw"), "is_excluded", "pusher_share")
    return dim.withColumn("weight", F.col("raw") / F.sum("raw").over(Window.partitionBy()))


def A01_counters(s: S, d: str) -> DataFrame:
    rows = once(raw_counts(files(s, d), "text", "file_id", "lang"), ["lang"], "tokens", "labelled")
    return rows.groupBy("lang").agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens"), F.sum("labelled").alias("labelled"), F.sum(F.col("tokens") - F.col("labelled")).alias("masked"))


def A02_coverage(s: S, d: str) -> DataFrame:
    """Languages seen, the weight that they cover, and the labels' parts per mille as ``class:part,…``."""
    seen = A01_counters(s, d).where("tokens > 0").select("lang", F.lit(1).alias("has"))
    cover = weights(s, d).join(seen, "lang", "left").agg(F.sum(F.coalesce("has", F.lit(0))).alias("languages"), F.round(F.sum(F.when(F.col("has") == 1, F.col("weight")).otherwise(0.0)), 9).alias("weight_covered"))
    c = confusion(s, d).groupBy("gold").agg(F.sum("n").alias("n")).withColumn("part", F.floor(F.col("n") * 1000 / F.sum("n").over(Window.partitionBy())))  # nine classes
    labels = c.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gold", "part"))), lambda x: F.concat_ws(":", x["gold"].cast("string"), x["part"].cast("string"))), ",").alias("labels"))
    return cover.withColumn("k", F.lit(1)).join(labels.withColumn("k", F.lit(1)), "k").drop("k")


def class_counts(s: S, d: str) -> DataFrame:
    c = confusion(s, d).groupBy(F.col("gold").alias("cls")).agg(F.sum("n").alias("f"))
    return s.range(len(CLASSES)).select(F.col("id").cast("int").alias("cls")).join(c, "cls", "left").select("cls", F.greatest(F.coalesce("f", F.lit(0)), F.lit(1)).alias("f"))


def A03_class_weights(s: S, d: str) -> DataFrame:
    w = Window.partitionBy()
    out = class_counts(s, d).withColumn("all", F.sum("f").over(w))
    for name, e in (("compact", 0.5), ("large", 0.25)):
        out = out.withColumn(f"raw_{name}", F.pow(F.col("all") / F.col("f"), F.lit(e)))
        out = out.withColumn(name, F.round(F.col(f"raw_{name}") / F.avg(f"raw_{name}").over(w), 9))
    return out.select("cls", "compact", "large")


def A04_language_accuracy(s: S, d: str) -> DataFrame:
    return hits(s, d).where("total > 0").select("lang", "hit", "total", F.round(F.col("hit") / F.col("total"), 9).alias("accuracy"))


def A05_class_recall(s: S, d: str) -> DataFrame:
    c = confusion(s, d).groupBy("gold").agg(F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"), F.sum("n").alias("total"))
    return c.select(F.col("gold").alias("cls"), "hit", "total", F.round(F.col("hit") / F.col("total"), 9).alias("recall"))


def A06_weighted_micro_macro(s: S, d: str) -> DataFrame:
    m = weights(s, d).join(hits(s, d), "lang", "left")
    acc = F.coalesce(F.col("hit") / F.col("total"), F.lit(0.0))
    return m.agg(F.round(F.sum(F.col("weight") * acc), 9).alias("weighted"), F.round(F.sum("hit") / F.sum("total"), 9).alias("micro"), F.round(F.sum(acc) / F.count("*"), 9).alias("macro"))


def A07_benchmark(s: S, d: str) -> DataFrame:
    """Weights of the leading languages only; one without a score counts 0."""
    top = table(s, d, "lang_dim").where("pusher_share IS NOT NULL").orderBy(F.desc("pusher_share"), "lang").limit(TOP).select("lang", "pusher_share")
    m = top.join(hits(s, d), "lang", "left")
    return m.agg(F.round(F.sum(F.col("pusher_share") * F.coalesce(F.col("hit") / F.col("total"), F.lit(0.0))) / F.sum("pusher_share"), 9).alias("weighted"))


def A08_renormalized(s: S, d: str) -> DataFrame:
    m = weights(s, d).join(hits(s, d), "lang").where("total > 0 AND NOT coalesce(is_excluded, false)")
    return m.agg(F.round(F.sum(F.col("weight") * F.col("hit") / F.col("total")) / F.sum("weight"), 9).alias("weighted"), F.count("*").alias("languages"))


def A09_boundary_f1(s: S, d: str) -> DataFrame:
    one = once(boundary_counts(files(s, d), "text", "file_id", "lang"), ["lang"], "tp", "predicted", "gold", "scored")
    # languages with a pair of scored tokens
    out = one.where("scored > 1").groupBy("lang").agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("gold").alias("gold"))
    return out.withColumn("f1", F.round(F.when(F.col("predicted") + F.col("gold") > 0, 2.0 * F.col("tp") / (F.col("predicted") + F.col("gold"))).otherwise(0.0), 9))


def A10_confusion(s: S, d: str) -> DataFrame:
    return confusion(s, d).select("gold", "pred", "n")


def A11_top_confusions(s: S, d: str) -> DataFrame:
    w = Window.partitionBy("gold").orderBy(F.desc("n"), "pred")
    return confusion(s, d).where("gold <> pred").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("gold", "pred", "n", "rank")


def A12_loss_ranking(s: S, d: str) -> DataFrame:
    m = weights(s, d).join(hits(s, d), "lang").select("lang", F.round(F.col("weight") * (1 - F.col("hit") / F.col("total")), 9).alias("loss"))
    return m.orderBy(F.desc("loss"), "lang").limit(8)


def repo_of(path: Column) -> Column:
    """Owner and repository from a flattened name, ``?`` without both."""
    parts = F.split(F.element_at(F.split(path, r"[/\\]"), -1), "__")
    return F.when(F.size(parts) > 2, F.concat_ws("__", F.slice(parts, 1, 2))).otherwise("?")


def A13_health(s: S, d: str) -> DataFrame:
    """Per language: files, tokens, share of the largest repository, masked share, leading classes."""
    df = labelled_texts(s, d, repo_of(F.col("path")).alias("repo"))
    rows = aligned_counts(df, "text", "rle", "compact_v2", ["label"], "line_no", "file_id", "lang", "repo")
    cell = once(rows, ["line_no", "lang", "repo", "label"], "n").withColumn("label", F.when(F.col("label") >= 0, F.col("label").cast("int")))
    cell = durable(cell, "health-cells")
    files_ = cell.select("lang", "line_no", "file_id").distinct().groupBy("lang").agg(F.count("*").alias("files"))
    total = cell.groupBy("lang").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("label").isNull(), F.col("n")).otherwise(0)).alias("masked"))
    repo = cell.groupBy("lang", "repo").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.max("n").alias("top_repo"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "label")
    cls = cell.where("label IS NOT NULL").groupBy("lang", "label").agg(F.sum("n").alias("n")).withColumn("r", F.row_number().over(w)).where("r <= 3")
    top = cls.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda x: x["label"].cast("string")), ",").alias("classes"))
    keyed = lambda x: x.withColumn("lang", F.coalesce("lang", F.lit("?")))
    out = keyed(total).join(keyed(files_), "lang").join(keyed(repo), "lang").join(keyed(top), "lang", "left")
    return out.select("lang", "files", "tokens", "masked", "top_repo", (F.col("top_repo") * 2 > F.col("tokens")).alias("one_sided"), F.coalesce("classes", F.lit("")).alias("classes"))


def A14_agreement(s: S, d: str) -> DataFrame:
    """Characters other than blanks whose class agrees."""
    c = confusion(s, d, "lang").groupBy("lang").agg(F.sum(F.when(F.col("gold") == F.col("pred"), F.col("chars")).otherwise(0)).alias("hit"), F.sum("chars").alias("total"))
    return c


def A15_gated_agreement(s: S, d: str) -> DataFrame:
    """Agreement of labels with the prediction by kind, over characters whose label is certain.

    A label line vouches for its file (confidence 1) if its runs cover the text exactly, else it is in doubt (0.5).
    """
    sure = F.when(rle_length(F.col("rle")) == F.length("text"), 1.0).otherwise(0.5)
    rows = labelled(s, d, "compact_v2", ["kind", "start", "end"], sure.alias("confidence")).where("label IS NOT NULL AND confidence >= 1")
    size = F.col("end") - F.col("start")
    same = F.col("label") == F.when(F.col("kind") == 3, 8).otherwise(0)
    one = per_file(rows, ["line_no", "lang"], hit=F.sum(F.when(same, size).otherwise(0)), total=F.sum(size))
    return one.groupBy("lang").agg(F.sum("hit").alias("hit"), F.sum("total").alias("total"))


def A16_unsupported(s: S, d: str) -> DataFrame:
    """An engine without the language: nothing hit out of all visible code points."""
    one = file_values(s, d, "lang", F.length(F.regexp_replace("text", JS_BLANK, "")).alias("visible"))
    return one.groupBy("lang").agg(F.lit(0).cast("long").alias("hit"), F.sum("visible").alias("total"))


def A17_engine_macro(s: S, d: str) -> DataFrame:
    """Mean score of the large target's languages by labelling engine: the first has the compact target's grammars."""
    engine = F.when(F.col("lang").isin(*dims.TARGETS), "first").otherwise("second")
    dim = s.createDataFrame([(x,) for x in dims.TARGETS_LARGE], "lang string").withColumn("engine", engine)
    m = dim.join(hits(s, d), "lang", "left")
    return m.groupBy("engine").agg(F.count("*").alias("languages"), F.round(F.avg(F.coalesce(F.col("hit") / F.col("total"), F.lit(0.0))), 9).alias("macro"))


def A18_underfilled(s: S, d: str) -> DataFrame:
    return A01_counters(s, d).where(F.col("tokens") < UNDERFILLED).select("lang", "tokens")


def windows(s: S, d: str) -> DataFrame:
    """The cached windows, each once."""
    w = table(s, d, "windows")
    cols = [c for c in w.columns if c not in ("win_id", "built_at")]
    return w.groupBy("win_id").agg(*[F.max(c).alias(c) for c in cols])


def A19_run_summary(s: S, d: str) -> DataFrame:
    """Mean and population deviation of labelled tokens per language."""
    return windows(s, d).groupBy("lang_id").agg(F.count("*").alias("runs"), F.round(F.avg("n_labelled"), 9).alias("mean"), F.round(F.stddev_pop("n_labelled"), 6).alias("std"))


def A20_median(s: S, d: str) -> DataFrame:
    """The median of the medians of the sources' text lengths."""
    one = table(s, d, "documents").groupBy("doc_id").agg(F.max(F.lower(F.trim("source"))).alias("source"), F.max(F.length("text")).alias("n"))
    return one.where("source IS NOT NULL AND n IS NOT NULL").groupBy("source").agg(F.median("n").alias("m")).agg(F.median("m").alias("median"))


def A21_buckets(s: S, d: str) -> DataFrame:
    """Languages by the first bound that their accuracy reaches."""
    acc = F.col("hit") * 100 / F.col("total")
    bucket = F.when(acc >= 95, 95).when(acc >= 90, 90).when(acc >= 80, 80).when(acc >= 70, 70).when(acc >= 60, 60).when(acc >= 50, 50).otherwise(0)
    return hits(s, d).where("total > 0").groupBy(bucket.alias("bucket")).agg(F.array_join(F.array_sort(F.collect_list("lang")), ",").alias("languages"))


def A22_packed_size(s: S, d: str) -> DataFrame:
    """Packed bytes of the vectors by bits: rows padded to 32, one scale of two bytes each."""
    e = table(s, d, "embeddings").groupBy("vec_id").agg(F.max(F.size("embedding")).alias("n"))
    bits = e.select("n", F.explode(F.array(*[F.lit(b) for b in (1, 2, 3, 4)])).alias("bits"))
    return bits.groupBy("bits").agg(F.sum(F.floor((F.col("n") + 31) / 32) * 4 * F.col("bits")).alias("plane_bytes"), F.sum(F.lit(2).cast("long")).alias("scale_bytes"))


def _constructs(s: S, d: str) -> DataFrame:
    """``line_no, file_id, win, complete``: complete comment and string runs per window of 512 tokens."""
    rows = construct_counts(labelled_texts(s, d), "text", "rle", CONSTRUCT, "line_no", "file_id")
    return rows.groupBy("line_no", "file_id", "win").agg(F.max("complete").alias("complete"))


def boosts(s: S, d: str) -> DataFrame:
    """``file_id, chunk_ix, boost`` of windows with complete constructs."""
    boost = 1 + 0.5 * F.least(F.lit(1.0), F.col("complete") / 2)
    return _constructs(s, d).groupBy("file_id", F.col("win").cast("int").alias("chunk_ix")).agg(F.max(boost).alias("boost"))


def A24_constructs(s: S, d: str) -> DataFrame:
    boost = 1 + 0.5 * F.least(F.lit(1.0), F.col("complete") / 2)
    return _constructs(s, d).groupBy("complete").agg(F.count("*").alias("windows"), F.round(F.sum(boost), 6).alias("weight"))


def A25_distinct_content(s: S, d: str) -> DataFrame:
    one = file_values(s, d, F.sha2("text", 256).alias("digest"), F.lower(F.trim("split")).alias("split"))
    return one.groupBy("split").agg(F.count("digest").alias("texts"), F.countDistinct("digest").alias("distinct_texts"))


def W03_clamped_depth(s: S, d: str) -> DataFrame:
    """Depth as a running sum cut at 0 afterwards: an unmatched closer has to be repaid."""
    rows = depth_counts(labelled_texts(s, d), "text", "rle", "line_no", "file_id")
    names = [c for c in rows.columns if c not in ("line_no", "file_id")]
    return once(rows, ["line_no"], *names).agg(*[F.sum(n).alias(n) for n in names])


def W04_previous_scored(s: S, d: str) -> DataFrame:
    """Pairs of gold classes of consecutive scored tokens."""
    keys = ["prev_gold", "gold"]
    rows = once(scored_counts(files(s, d), "text", keys, "file_id"), keys, "n")
    return rows.groupBy(*[F.col(k).cast("int").alias(k) for k in keys]).agg(F.sum("n").alias("n"))


def W05_boundary_adjacent(s: S, d: str) -> DataFrame:
    """Scored tokens on either side of a gold transition."""
    one = once(boundary_counts(files(s, d), "text", "file_id", "lang"), ["lang"], "adjacent")
    return one.groupBy("lang").agg(F.sum("adjacent").alias("adjacent"))


_CONF = f"{SQL_GOLD}, c AS (SELECT lang, gold, pred, count(*) AS n, sum(len) AS chars FROM gold WHERE gold >= 0 GROUP BY ALL), h AS (SELECT lang, coalesce(sum(n) FILTER (gold = pred), 0) AS hit, sum(n) AS total FROM c WHERE lang IS NOT NULL GROUP BY lang), w AS (SELECT lang, coalesce(pusher_share, 0.25) / sum(coalesce(pusher_share, 0.25)) OVER () AS weight, is_excluded, pusher_share FROM lang_dim)"
_SC = f"{SQL_GOLD}, sc AS (SELECT *, lag(gold) OVER w AS pg, lag(pred) OVER w AS pp, lead(gold) OVER w AS ng FROM gold WHERE gold >= 0 WINDOW w AS (PARTITION BY file_id ORDER BY ix))"
_WIN = "win AS (SELECT win_id, max(file_id) AS file_id, max(chunk_ix) AS chunk_ix, max(repo) AS repo, max(lang_id) AS lang_id, max(split) AS split, max(tok_from) AS tok_from, max(tok_to) AS tok_to, max(n_labelled) AS n_labelled, max(shape_fp) AS shape_fp FROM windows GROUP BY win_id)"
_KEPT = "k AS (SELECT *, row_number() OVER (PARTITION BY line_no, file_id ORDER BY ix) - 1 AS kx FROM al WHERE kind IN (0, 3))"
SQL_CONSTRUCTS = f"""{SQL_LABELLED}, {_KEPT}, r AS (SELECT line_no, file_id, kx // {CONSTRUCT} AS win, label, lag(label) OVER w AS p, lead(label) OVER w AS q FROM k WHERE label IS NOT NULL WINDOW w AS (PARTITION BY line_no, file_id, kx // {CONSTRUCT} ORDER BY kx)),
      o AS (SELECT line_no, file_id, win, count(*) AS scored, count_if(label = 1 AND p IS DISTINCT FROM 1) AS s1, count_if(label = 1 AND q IS DISTINCT FROM 1) AS e1, count_if(label = 2 AND p IS DISTINCT FROM 2) AS s2, count_if(label = 2 AND q IS DISTINCT FROM 2) AS e2 FROM r GROUP BY ALL),
      c AS (SELECT file_id, win, CASE WHEN scored >= 3 THEN least(s1, e1) + least(s2, e2) ELSE 0 END::BIGINT AS complete FROM o)"""
SQL = {
    "A01_counters": f"WITH {SQL_GOLD} SELECT lang, count(DISTINCT file_id) AS files, count(*) AS tokens, count_if(gold >= 0)::BIGINT AS labelled, count_if(gold < 0)::BIGINT AS masked FROM gold GROUP BY lang",
    "A02_coverage": f"WITH {_CONF} SELECT count(h.lang) AS languages, round(sum(CASE WHEN h.lang IS NOT NULL THEN weight ELSE 0 END), 9) AS weight_covered, (SELECT string_agg(gold || ':' || floor(n * 1000 / total)::BIGINT, ',' ORDER BY gold) FROM (SELECT gold, sum(n) AS n, sum(sum(n)) OVER () AS total FROM c GROUP BY gold)) AS labels FROM w LEFT JOIN h USING (lang)",
    "A03_class_weights": f"WITH {_CONF}, fr AS (SELECT i::INT AS cls, greatest(coalesce(sum(n), 0), 1) AS f FROM range(9) t(i) LEFT JOIN c ON c.gold = i GROUP BY i), r AS (SELECT cls, pow(sum(f) OVER () / f, 0.5) AS a, pow(sum(f) OVER () / f, 0.25) AS b FROM fr) SELECT cls, round(a / avg(a) OVER (), 9) AS compact, round(b / avg(b) OVER (), 9) AS large FROM r",
    "A04_language_accuracy": f"WITH {_CONF} SELECT lang, hit::BIGINT AS hit, total::BIGINT AS total, round(hit / total, 9) AS accuracy FROM h",
    "A05_class_recall": f"WITH {_CONF} SELECT gold AS cls, coalesce(sum(n) FILTER (gold = pred), 0)::BIGINT AS hit, sum(n)::BIGINT AS total, round(coalesce(sum(n) FILTER (gold = pred), 0) / sum(n), 9) AS recall FROM c GROUP BY gold",
    "A06_weighted_micro_macro": f"WITH {_CONF} SELECT round(sum(weight * coalesce(hit / total, 0)), 9) AS weighted, round(sum(hit) / sum(total), 9) AS micro, round(sum(coalesce(hit / total, 0)) / count(*), 9) AS macro FROM w LEFT JOIN h USING (lang)",
    "A07_benchmark": f"WITH {_CONF}, t AS (SELECT lang, pusher_share FROM lang_dim WHERE pusher_share IS NOT NULL ORDER BY pusher_share DESC, lang LIMIT {TOP}) SELECT round(sum(pusher_share * coalesce(hit / total, 0)) / sum(pusher_share), 9) AS weighted FROM t LEFT JOIN h USING (lang)",
    "A08_renormalized": f"WITH {_CONF} SELECT round(sum(weight * hit / total) / sum(weight), 9) AS weighted, count(*) AS languages FROM w JOIN h USING (lang) WHERE NOT coalesce(is_excluded, false)",
    "A09_boundary_f1": f"WITH {_SC}, b AS (SELECT lang, count_if(gold <> pg AND pred <> pp) AS tp, count_if(pred <> pp) AS predicted, count_if(gold <> pg) AS g FROM sc WHERE pg IS NOT NULL GROUP BY lang) SELECT lang, tp::BIGINT AS tp, predicted::BIGINT AS predicted, g::BIGINT AS gold, round(CASE WHEN predicted + g > 0 THEN 2.0 * tp / (predicted + g) ELSE 0 END::DOUBLE, 9) AS f1 FROM b",
    "A10_confusion": f"WITH {_CONF} SELECT gold, pred, sum(n)::BIGINT AS n FROM c GROUP BY ALL",
    "A11_top_confusions": f"WITH {_CONF}, t AS (SELECT gold, pred, sum(n)::BIGINT AS n FROM c WHERE gold <> pred GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY gold ORDER BY n DESC, pred)::INT AS rank FROM t) SELECT * FROM r WHERE rank <= 3",
    "A12_loss_ranking": f"WITH {_CONF} SELECT lang, round(weight * (1 - hit / total), 9) AS loss FROM w JOIN h USING (lang) ORDER BY loss DESC, lang LIMIT 8",
    "A13_health": rf"""WITH {SQL_LABELLED}, {_KEPT}, z AS (SELECT k.line_no, k.file_id, coalesce(k.lang, '?') AS lang, k.label, string_split(string_split_regex(ll.path, '[/\\]')[-1], '__') AS parts FROM k JOIN ll ON k.line_no = ll.line_no),
      q AS (SELECT *, CASE WHEN len(parts) > 2 THEN parts[1] || '__' || parts[2] ELSE '?' END AS repo FROM z), t AS (SELECT lang, count(DISTINCT (line_no, file_id)) AS files, count(*) AS tokens, count_if(label IS NULL)::BIGINT AS masked FROM q GROUP BY lang),
      r AS (SELECT lang, max(n) AS top_repo FROM (SELECT lang, repo, count(*) AS n FROM q GROUP BY ALL) GROUP BY lang), c AS (SELECT lang, string_agg(label::VARCHAR, ',' ORDER BY r) AS classes FROM (SELECT lang, label, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, label) AS r FROM q WHERE label IS NOT NULL GROUP BY lang, label) WHERE r <= 3 GROUP BY lang)
      SELECT t.lang, files, tokens, masked, top_repo, top_repo * 2 > tokens AS one_sided, coalesce(classes, '') AS classes FROM t JOIN r USING (lang) LEFT JOIN c USING (lang)""",
    "A14_agreement": f"WITH {_CONF} SELECT lang, coalesce(sum(chars) FILTER (gold = pred), 0)::BIGINT AS hit, sum(chars)::BIGINT AS total FROM c GROUP BY lang",
    "A15_gated_agreement": f"WITH {SQL_LABELLED}, cv AS (SELECT line_no, sum(n) AS covered FROM r0 GROUP BY line_no), k AS (SELECT al.lang, al.len, label, kind FROM al JOIN cv ON al.line_no = cv.line_no JOIN f ON f.file_id = al.file_id WHERE kind IN (0, 3) AND label IS NOT NULL AND covered = length(text)) SELECT lang, coalesce(sum(len) FILTER (label = CASE kind WHEN 3 THEN 8 ELSE 0 END), 0)::BIGINT AS hit, sum(len)::BIGINT AS total FROM k GROUP BY lang",
    "A16_unsupported": f"WITH {SQL_FILES} SELECT lang, 0::BIGINT AS hit, sum(length(regexp_replace(text, '{JS_BLANK}', '', 'g')))::BIGINT AS total FROM f GROUP BY lang",
    "A17_engine_macro": f"WITH {_CONF}, t AS (SELECT t AS lang, t IN (SELECT c FROM (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in dims.TARGETS)}) v(c)) AS first FROM (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in dims.TARGETS_LARGE)}) v(t)) SELECT CASE WHEN first THEN 'first' ELSE 'second' END AS engine, count(*) AS languages, round(avg(coalesce(hit / total, 0)), 9) AS macro FROM t LEFT JOIN h ON t.lang = h.lang GROUP BY ALL",
    "A18_underfilled": f"WITH {SQL_GOLD} SELECT lang, count(*) AS tokens FROM gold GROUP BY lang HAVING count(*) < {UNDERFILLED}",
    "A19_run_summary": f"WITH {_WIN} SELECT lang_id, count(*) AS runs, round(avg(n_labelled), 9) AS mean, round(stddev_pop(n_labelled), 6) AS std FROM win GROUP BY lang_id",
    "A20_median": "WITH o AS (SELECT doc_id, max(lower(trim(source))) AS source, max(length(text)) AS n FROM documents GROUP BY doc_id), m AS (SELECT median(n) AS m FROM o WHERE source IS NOT NULL AND n IS NOT NULL GROUP BY source) SELECT median(m) AS median FROM m",
    "A21_buckets": f"WITH {_CONF}, b AS (SELECT lang, hit * 100 / total AS a FROM h) SELECT CASE WHEN a >= 95 THEN 95 WHEN a >= 90 THEN 90 WHEN a >= 80 THEN 80 WHEN a >= 70 THEN 70 WHEN a >= 60 THEN 60 WHEN a >= 50 THEN 50 ELSE 0 END AS bucket, string_agg(lang, ',' ORDER BY lang) AS languages FROM b GROUP BY ALL",
    "A22_packed_size": "WITH e AS (SELECT vec_id, max(len(embedding)) AS n FROM embeddings GROUP BY vec_id) SELECT bits::INT AS bits, sum((n + 31) // 32 * 4 * bits)::BIGINT AS plane_bytes, sum(2)::BIGINT AS scale_bytes FROM e, range(1, 5) t(bits) GROUP BY bits",
    "A24_constructs": f"WITH {SQL_CONSTRUCTS} SELECT complete, count(*) AS windows, round(sum(1 + 0.5 * least(1.0, complete / 2)), 6) AS weight FROM c GROUP BY complete",
    "A25_distinct_content": f"WITH {SQL_FILES} SELECT lower(trim(split)) AS split, count(text) AS texts, count(DISTINCT sha256(text)) AS distinct_texts FROM f GROUP BY ALL",
    "W03_clamped_depth": f"""WITH {SQL_LABELLED}, {_KEPT}, r AS (SELECT lag(label) OVER w AS b, {", ".join(f"greatest(0, sum(CASE WHEN t = '{o}' THEN 1 WHEN t = '{c}' THEN -1 ELSE 0 END) OVER w) AS {n}" for n, o, c in (("paren", "(", ")"), ("brace", "{", "}"), ("bracket", "[", "]")))} FROM k WINDOW w AS (PARTITION BY line_no, file_id ORDER BY kx))
      SELECT count_if(b = 1)::BIGINT AS after_comment, count_if(b = 2)::BIGINT AS after_string, {", ".join(f"count_if({n} >= {i})::BIGINT AS {n}{i}" for n in ("paren", "brace", "bracket") for i in (1, 2))} FROM r""",
    "W04_previous_scored": f"WITH {_SC} SELECT coalesce(pg, -1) AS prev_gold, gold, count(*) AS n FROM sc GROUP BY ALL",
    "W05_boundary_adjacent": f"WITH {_SC} SELECT lang, count_if(pg <> gold OR ng <> gold)::BIGINT AS adjacent FROM sc GROUP BY lang",
}
QUERIES = {k: v for k, v in globals().items() if k[:1] in "AW" and k[1:3].isdigit()}
