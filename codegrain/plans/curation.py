"""Queries of sources, sinks, filters, joins, set operations and curation (S, K, F, J, W08 to W11, P, T, U)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codegrain import dims
from codegrain.functions.lexing import split_of
from codegrain.operators import allocate as al
from codegrain.operators import curate as cu
from codegrain.operators.durable import durable
from codegrain.operators.ordered import running_sum
from codegrain.functions.labels import aligned_counts
from codegrain.plans.common import SQL_FILES, SQL_GOLD, file_values, files, once, one_per_file, per_file
from codegrain.plans.labels import SQL_LABELLED, label_lines, labelled_texts, scored
from codegrain.plans.metrics import SQL_CONSTRUCTS, boosts, confusion, hits, weights, windows
from codegrain.tables import table

S = SparkSession
TOTAL = 24_000_000
TOTAL_LARGE = 160_000_000
SHORT, SHORT_LEAST = 6_000, 300


def aliases(s: S, d: str) -> DataFrame:
    """``alias, lang`` of the fixed language table, lower case."""
    names = F.array_union(F.array("lang"), F.coalesce("aliases", F.array().cast("array<string>")))
    return table(s, d, "lang_dim").select(F.explode(F.transform(names, F.lower)).alias("alias"), "lang").groupBy("alias").agg(F.min("lang").alias("lang"))


def S02_label_shards(s: S, d: str) -> DataFrame:
    """Label lines of known languages whose grammar fits, by shard."""
    folder = F.element_at(F.split("path", r"[/\\]"), F.lit(-2))
    parts = F.size(F.split("path", r"[/\\]"))
    lines = label_lines(s, d).where("path IS NOT NULL").withColumn("folder", F.when(parts >= 2, folder))
    met = lines.join(F.broadcast(table(s, d, "lang_dim").select("lang")), F.col("folder") == F.col("lang"))
    return met.groupBy("shard").agg(F.count("*").alias("lines"), F.sum((~cu.dialect_ok(F.col("lang"), F.col("path"))).cast("long")).alias("skipped"))


def S06_denylist(s: S, d: str) -> DataFrame:
    """Digests of the held-out texts, each once."""
    one = file_values(s, d, F.lower(F.trim("split")).alias("split"), F.sha2("text", 256).alias("digest"))
    return one.where("split = 'test' AND digest IS NOT NULL").select("digest").distinct()


def S07_popularity(s: S, d: str) -> DataFrame:
    """The leading languages and their part of all shares."""
    dim = table(s, d, "lang_dim").where("pusher_share IS NOT NULL")
    top = dim.orderBy(F.desc("pusher_share"), "lang").limit(25).select("lang", "pusher_share")
    return top.select("lang", F.round(F.col("pusher_share") / F.sum("pusher_share").over(Window.partitionBy()), 9).alias("weight"))


#: Ids that a manifest leaves out.
NOT_LISTED = ("erlang-repl", "julia-repl", "python-repl", "clojure-repl", "node-repl", "php-template", "xl", "excel")


def S13_manifest(s: S, d: str) -> DataFrame:
    """Names as delivered, looked up folded: by language, then grammar, then alias; and the engine that teaches each."""
    fold = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    dim = table(s, d, "lang_dim")
    a = dim.select(fold(F.col("lang")).alias("k"), "lang", F.lit(1).alias("r"))
    g = dim.select(fold(cu.grammar_of(F.col("lang"))).alias("k"), "lang", F.lit(2).alias("r"))
    b = dim.select(F.explode("aliases").alias("x"), "lang").select(fold(F.col("x")).alias("k"), "lang", F.lit(3).alias("r"))
    best = a.union(g).union(b).where("k <> ''").groupBy("k").agg(F.min_by("lang", F.struct("r", "lang")).alias("found"))
    names = one_per_file(s, d, "lang").where("lang IS NOT NULL").select("lang").distinct().where(~F.col("lang").isin(*NOT_LISTED))
    met = names.withColumn("k", fold(F.col("lang"))).join(F.broadcast(best), "k", "left")
    return met.select("lang", "found", F.when(F.col("found").isin(*dims.TARGETS), "first").when(F.col("found").isNotNull(), "second").alias("engine"))


def S14_reuse(s: S, d: str) -> DataFrame:
    """Files under canonical names, those already in the windows left out."""
    f = one_per_file(s, d, "lang").withColumn("alias", F.lower("lang")).drop("lang")
    new = f.join(F.broadcast(aliases(s, d)), "alias").join(windows(s, d).select("file_id").distinct(), "file_id", "left_anti")
    return new.groupBy("lang").agg(F.count("*").alias("files"))


def K01_label_lines(s: S, d: str) -> DataFrame:
    """Lines as written to a label file, and those dropped."""
    t = table(s, d, "label_lines").groupBy("line_no").agg(F.max("path").alias("path"), F.max("rle").alias("rle"), F.max("shard").alias("shard"))
    ok = F.col("path").isNotNull() & (F.coalesce("rle", F.lit("")) != "")
    line = F.concat("path", F.lit("\t"), "rle")
    return t.groupBy("shard").agg(F.sum(ok.cast("long")).alias("written"), F.sum((~ok).cast("long")).alias("dropped"), F.sum(F.when(ok, F.length(line) + 1).otherwise(0)).alias("chars"))


def K03_split_cache(s: S, d: str) -> DataFrame:
    """What a split's cache holds: windows, tokens, files."""
    w = windows(s, d).withColumn("n", F.col("tok_to") - F.col("tok_from"))
    return w.groupBy("split").agg(F.count("*").alias("windows"), F.sum("n").alias("tokens"), F.countDistinct("file_id").alias("files"))


def K04_meta(s: S, d: str) -> DataFrame:
    w = windows(s, d)
    seen = w.select("lang_id").distinct().join(table(s, d, "lang_dim").select("lang_id", "lang"), "lang_id").select("lang", F.lit(1).alias("has"))
    cover = weights(s, d).join(seen, "lang", "left").agg(F.round(F.sum(F.when(F.col("has") == 1, F.col("weight")).otherwise(0.0)), 9).alias("coverage"), F.sum(F.coalesce("is_excluded", F.lit(False)).cast("long")).alias("excluded"))
    one = w.agg(F.count("*").alias("windows"), F.sum(F.col("tok_to") - F.col("tok_from")).cast("long").alias("tokens"), F.countDistinct("lang_id").alias("languages"), F.countDistinct("shape_fp").alias("shapes"))
    # one row each, brought together on a constant
    met = one.withColumn("k", F.lit(1)).join(cover.withColumn("k", F.lit(1)), "k").drop("k")
    return met.withColumn("feature_version", F.lit(2)).withColumn("requested", F.lit(TOTAL).cast("long"))


def K06_provenance(s: S, d: str) -> DataFrame:
    one = file_values(s, d, "lang", F.octet_length("text").alias("bytes"), F.sha2("text", 256).alias("digest"))
    return one.groupBy("lang").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.countDistinct("digest").alias("texts"))


def K07_checksums(s: S, d: str) -> DataFrame:
    return file_values(s, d, F.sha2("text", 256).alias("digest"))


def F01_paths(s: S, d: str) -> DataFrame:
    f = one_per_file(s, d, "path", "lang").withColumn("alias", F.lower("lang")).drop("lang")
    dim = aliases(s, d).join(table(s, d, "lang_dim").select("lang", "file_exts"), "lang")
    ok = cu.wanted_path(F.col("path"), F.col("file_exts"), cu.stems_of(F.col("lang")))
    # files named by a stem, of whatever language
    stem = F.lower(cu.base_name(F.col("path"))).rlike("^(" + "|".join(x.replace(".", r"\.") for v in dims.STEMS.values() for x in v) + r")($|\.)")
    met = f.where("path IS NOT NULL").join(F.broadcast(dim), "alias")
    return met.groupBy("lang").agg(F.sum(ok.cast("long")).alias("kept"), F.sum((~ok).cast("long")).alias("dropped"), F.sum(stem.cast("long")).alias("by_stem"))


def F02_size_band(s: S, d: str) -> DataFrame:
    one = file_values(s, d, "lang", cu.in_band(F.col("text")).alias("ok"))
    return one.groupBy("lang", "ok").agg(F.count("*").alias("files"))


def F03_truncate(s: S, d: str) -> DataFrame:
    cut = cu.truncate(F.col("text"), SHORT, SHORT_LEAST)
    return file_values(s, d, F.length(cut).alias("chars"), F.md5(cut).alias("digest"), (F.length("text") > SHORT).alias("cut"))


def F04_dialects(s: S, d: str) -> DataFrame:
    one = one_per_file(s, d, "path", "lang").where("path IS NOT NULL AND lang IS NOT NULL")
    return one.groupBy("lang").agg(F.sum(cu.dialect_ok(F.col("lang"), F.col("path")).cast("long")).alias("kept"), F.count("*").alias("files"))


def F05_denylist(s: S, d: str) -> DataFrame:
    """Files left after held-out texts are taken out of the other splits."""
    one = file_values(s, d, F.lower(F.trim("split")).alias("split"), F.sha2("text", 256).alias("digest"))
    held = one.where("split = 'test'").select("digest").distinct()
    return one.where("split <> 'test' AND digest IS NOT NULL").join(held, "digest", "left_anti").select("file_id", "split")


def F06_file_gate(s: S, d: str) -> DataFrame:
    rows = once(aligned_counts(labelled_texts(s, d), "text", "rle", "compact_v2", ["label"], "file_id", "line_no", "lang"), ["line_no", "lang", "label"], "n")
    one = rows.groupBy("file_id", "line_no", "lang").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("label") >= 0, F.col("n")).otherwise(0)).alias("labels"))
    ok = (F.col("tokens") >= 32) & (F.col("labels") >= 16)
    return one.groupBy("lang").agg(F.sum(ok.cast("long")).alias("kept"), F.sum((~ok).cast("long")).alias("dropped"))


def _chunks(s: S, d: str) -> DataFrame:
    """``file_id, line_no, chunk_ix, tokens, labels`` of runs of 512 tokens."""
    rows = once(aligned_counts(labelled_texts(s, d), "text", "rle", "compact_v2", ["chunk", "label"], "file_id", "line_no"), ["line_no", "chunk", "label"], "n")
    return rows.groupBy("file_id", "line_no", F.col("chunk").cast("int").alias("chunk_ix")).agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("label") >= 0, F.col("n")).otherwise(0)).alias("labels"))


def F07_chunk_gate(s: S, d: str) -> DataFrame:
    ok = (F.col("tokens") >= 32) & (F.col("labels") >= 16)
    return _chunks(s, d).groupBy("chunk_ix").agg(F.sum(ok.cast("long")).alias("kept"), F.sum((~ok).cast("long")).alias("dropped"), F.sum(F.when(ok, F.col("tokens")).otherwise(0)).alias("tokens"))


def F08_repos(s: S, d: str) -> DataFrame:
    return one_per_file(s, d, "path").where("path IS NOT NULL").groupBy(cu.repo_of(F.col("path")).alias("repo")).agg(F.count("*").alias("files"))


def F09_names(s: S, d: str) -> DataFrame:
    """Safe names; a repeated one gets a numeric suffix in the order of ids."""
    one = one_per_file(s, d, "path").where("path IS NOT NULL").withColumn("name", cu.flat_name(F.col("path")))
    one = durable(one.select("file_id", "name", F.lit(1).cast("long").alias("one")), "names")
    # places counted over cells of ids: one name may be that of any share of the files
    ranked = running_sum(cu.order_key(one, "file_id"), ["name"], "__key", ["file_id"], {"before": "one"})
    return ranked.select("file_id", F.when(F.col("before") == 0, F.col("name")).otherwise(F.concat("name", F.lit("-"), (F.col("before") + 1).cast("string"))).alias("name"))


def F10_aliases(s: S, d: str) -> DataFrame:
    """Files by the target language that their family is read as; null counts those dropped."""
    f = one_per_file(s, d, "lang").select(F.lower("lang").alias("family"))
    each = f.select(F.explode(F.array(*[F.struct(F.lit(n).alias("target"), cu.target_of(F.col("family"), n == "large").alias("lang")) for n in ("compact", "large")])).alias("x")).select("x.*")
    return each.groupBy("target", "lang").agg(F.count("*").alias("files"))


def F11_grammars(s: S, d: str) -> DataFrame:
    """Grammar id of every target language and every language of the table."""
    names = table(s, d, "lang_dim").select("lang").union(s.createDataFrame([(x,) for x in (*dims.TARGETS, *dims.GRAMMARS)], "lang string")).where("lang IS NOT NULL").distinct()
    return names.select("lang", cu.grammar_of(F.col("lang")).alias("grammar"))


BLOCK = 1_000


def F12_valid_utf8(s: S, d: str) -> DataFrame:
    """Texts as stored bytes, in blocks of 1,000: blocks that decode strictly, and those that cut a character."""
    raw = F.col("text").cast("binary")
    starts = F.when(F.octet_length("text") > 0, F.sequence(F.lit(1), F.octet_length("text"), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    ok = F.size(F.filter(starts, lambda i: F.is_valid_utf8(F.substring(raw, i, F.lit(BLOCK)))))
    one = file_values(s, d, F.is_valid_utf8(raw).alias("whole"), F.when(F.col("text").isNotNull(), F.size(starts)).alias("blocks"), F.when(F.col("text").isNotNull(), ok).alias("valid"))
    return one.groupBy("whole").agg(F.count("*").alias("files"), F.sum("blocks").alias("blocks"), F.sum("valid").alias("valid"))


def F13_policy(s: S, d: str) -> DataFrame:
    return weights(s, d).select("lang", F.round("weight", 9).alias("weight"), F.coalesce("is_excluded", F.lit(False)).alias("excluded"))


def F14_not_excluded(s: S, d: str) -> DataFrame:
    out = table(s, d, "lang_dim").where("is_excluded").select("lang")
    f = one_per_file(s, d, "lang").where("lang IS NOT NULL")
    return f.join(F.broadcast(out), "lang", "left_anti").groupBy("lang").agg(F.count("*").alias("files"))


def J03_labelled_files(s: S, d: str) -> DataFrame:
    lines = label_lines(s, d).where("path IS NOT NULL").select("path")
    return one_per_file(s, d, "path", "lang").join(lines, "path", "left_semi").groupBy("lang").agg(F.count("*").alias("files"))


def J04_language_ids(s: S, d: str) -> DataFrame:
    f = one_per_file(s, d, "lang").join(F.broadcast(table(s, d, "lang_dim").select("lang", "lang_id")), "lang")
    return f.groupBy("lang_id").agg(F.count("*").alias("files"))


def _repo_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\.git$", "")


def J06_repo_overlap(s: S, d: str) -> DataFrame:
    """Repositories of the windows that the catalogue has, and those that it lacks."""
    cat = table(s, d, "repos").where("slug IS NOT NULL").select(F.regexp_replace(_repo_key(F.col("slug")), "/", "__").alias("repo")).distinct()
    mine = windows(s, d).where("repo IS NOT NULL AND repo <> '?'").select(_repo_key(F.col("repo")).alias("repo")).distinct()
    both = mine.intersect(cat).select("repo", F.lit(True).alias("known"))
    return both.union(mine.join(cat, "repo", "left_anti").select("repo", F.lit(False).alias("known")))


MODELS, CLASSES_N = 2, 9


def joined_logits(wins: DataFrame, logits: DataFrame, key: str, values: str, width: int, made_for: str | None = None, digest: str | None = None) -> DataFrame:
    """``wins`` with the cached vector of each window; a cache of another shape or data set is an error.

    ``made_for`` is the digest of the data set that the cache names, ``digest`` that of the one at hand.
    """
    if made_for is not None and made_for != digest:
        raise ValueError("the logits were made from another data set")
    odd = logits.where(F.size(values) != width).limit(1).count()
    if odd:
        raise ValueError(f"the logits are not {width} wide")
    return wins.join(logits, key, "left")


def dataset_digest(wins: DataFrame) -> str:
    """A digest of the windows' ids and places, whatever their order."""
    r = wins.agg(F.count("*"), F.sum(F.xxhash64("win_id", "file_id", "tok_from", "tok_to").cast("decimal(38,0)"))).first()
    return f"{r[0]}:{r[1]}"


def _with_logits(s: S, d: str) -> DataFrame:
    e = table(s, d, "embeddings").where("embedding IS NOT NULL").groupBy(F.col("vec_id").alias("win_ix")).agg(F.first("embedding").alias("v"))
    # the cache has no keys: its rows are the windows' places in their order
    w = durable(windows(s, d), "windows").withColumn("all", F.lit(0)).withColumn("one", F.lit(1).cast("long"))
    w = running_sum(cu.order_key(w, "win_id"), ["all"], "__key", ["win_id"], {"win_ix": "one"}).drop("__key", "all", "one")
    return joined_logits(w, e, "win_ix", "v", 64, digest := dataset_digest(w), digest)


def J07_logits(s: S, d: str) -> DataFrame:
    """Windows with their cached vectors; windows without one show as missing."""
    w = _with_logits(s, d)
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return w.groupBy("split").agg(F.count("*").alias("windows"), F.count("v").alias("with_logits"), F.round(F.sum(total), 4).alias("total"))


def mixed_models(models: list[Column], fold: Column) -> Column:
    """Class scores of a window: the mean of the models trained on other folds, of all where the fold is -1."""
    n = len(models)

    def share(v: Column, m: int) -> Column:
        weight = F.when(fold < 0, 1.0 / n).when(fold == m, 0.0).otherwise(1.0 / (n - 1))
        return F.transform(v, lambda x: x.cast("double") * weight)

    out = share(models[0], 0)
    for m in range(1, n):
        out = F.zip_with(out, share(models[m], m), lambda a, b: a + b)
    return out


def file_folds(s: S, d: str) -> DataFrame:
    """``lang_id, file_id, size, fold`` of the files that the windows are from."""
    g = windows(s, d).where("lang_id IS NOT NULL").groupBy("lang_id", "file_id").agg(F.count("*").alias("size"))
    return al.folds(g, "lang_id", "file_id", "size")


def J08_fold_mix(s: S, d: str) -> DataFrame:
    """Class scores per window, mixed from two models by the fold of its file."""
    met = _with_logits(s, d).where("v IS NOT NULL").join(file_folds(s, d).select("lang_id", "file_id", "fold"), ["lang_id", "file_id"])
    mix = mixed_models([F.slice("v", m * CLASSES_N + 1, CLASSES_N) for m in range(MODELS)], F.col("fold"))
    one = met.select("win_id", "fold", mix.alias("mix"))
    return one.select("win_id", "fold", (F.array_position("mix", F.array_max("mix")) - 1).cast("int").alias("cls"), F.round(F.array_max("mix"), 6).alias("top"))


def J09_reference_cases(s: S, d: str) -> DataFrame:
    """Per file: tokens, equal ones, and the first place where gold and prediction differ."""
    rows = scored(s, d).where("gold >= 0")
    diff = F.col("gold") != F.col("pred")
    return per_file(rows, [], n=F.count("*"), same=F.sum((~diff).cast("long")), first=F.min(F.when(diff, F.col("tok_ix")))).select("file_id", "n", "same", F.coalesce("first", F.lit(-1)).alias("first_diff"))


def W08_file_groups(s: S, d: str) -> DataFrame:
    """Files recovered from windows in order: a short window or another language ends one."""
    w = windows(s, d).select("win_id", "lang_id", (F.col("tok_to") - F.col("tok_from")).alias("n"))
    # one ordered pass over all windows: the comparison needs the neighbour only, so ranges of ids with the
    # last row of the range before carry it; sums of new groups per range are added up afterwards
    cell = F.floor(F.col("win_id") / 1_000_000)
    w = w.withColumn("cell", cell)
    inner = Window.partitionBy("cell").orderBy("win_id")
    edge = w.groupBy("cell").agg(F.max_by(F.struct("n", "lang_id"), "win_id").alias("last"))
    edge = edge.select("cell", F.lag("last").over(Window.orderBy("cell")).alias("before"))
    r = w.join(edge, "cell").withColumn("prev", F.coalesce(F.lag(F.struct("n", "lang_id")).over(inner), F.col("before")))
    new = F.col("prev").isNull() | (F.col("prev.n") < 512) | ~F.col("prev.lang_id").eqNullSafe(F.col("lang_id"))
    r = r.withColumn("new", new.cast("long"))
    base = r.groupBy("cell").agg(F.sum("new").alias("s")).select("cell", F.coalesce(F.sum("s").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return r.join(base, "cell").select("win_id", (F.col("base") + F.sum("new").over(inner) - 1).alias("group_id"))


def W09_chunks(s: S, d: str) -> DataFrame:
    return _chunks(s, d).groupBy("chunk_ix", (F.col("tokens") == 512).alias("whole")).agg(F.count("*").alias("chunks"))


def ordered_windows(s: S, d: str) -> DataFrame:
    """Windows with the order of their files and their tokens; those of unknown language left out."""
    order = files(s, d).groupBy("file_id").agg(F.max("ord").alias("ord"))
    return windows(s, d).where("lang_id IS NOT NULL").withColumn("n", F.col("tok_to") - F.col("tok_from")).join(order, "file_id")


def W10_dup_cap(s: S, d: str) -> DataFrame:
    return cu.cap_duplicates(ordered_windows(s, d), "shape_fp", ["ord", "chunk_ix", "win_id"]).select("win_id", "shape_fp")


def _budgets(s: S, d: str) -> dict[int, int]:
    """Half an even share of all tokens for each of the fixed languages."""
    total = ordered_windows(s, d).agg(F.sum("n")).first()[0] or 0
    ids = [r[0] for r in table(s, d, "lang_dim").select("lang_id").collect()]  # fixed: 26 rows
    return {i: total // (2 * len(ids)) for i in ids}


def W11_budget_cut(s: S, d: str) -> DataFrame:
    per = ordered_windows(s, d).groupBy("lang_id", "ord").agg(F.sum("n").alias("n"))
    return cu.budget_cut(per, "lang_id", "ord", "n", _budgets(s, d)).select("lang_id", "ord", "n")


def P21_fixpoint_build(s: S, d: str) -> DataFrame:
    """Cap and budgets as one ordered pass: kept windows."""
    kept, _ = cu.build(ordered_windows(s, d), "lang_id", "ord", "chunk_ix", "shape_fp", "n", _budgets(s, d))
    return kept.select("lang_id", "ord", "chunk_ix", "n")


def P01_split(s: S, d: str) -> DataFrame:
    return file_values(s, d, split_of(F.col("text")).alias("split")).where("split IS NOT NULL")


def P02_split_repair(s: S, d: str) -> DataFrame:
    w = ordered_windows(s, d).select("win_id", "lang_id", "split", "ord", "chunk_ix")
    out = cu.repair_splits(w, "lang_id", "split", ["ord", "chunk_ix", "win_id"])
    return out.groupBy("lang_id", "split").agg(F.count("*").alias("windows"), F.sum("win_id").alias("checksum"))


def _frame(s: S, values: dict, schema: str) -> DataFrame:
    return s.createDataFrame(list(values.items()), schema)


def P03_weights(s: S, d: str) -> DataFrame:
    return _frame(s, al.compact_weights(), "lang string, weight double").select("lang", F.round("weight", 9).alias("weight"))


def P04_weights_large(s: S, d: str) -> DataFrame:
    targets = sorted(dims.TARGETS_LARGE)
    return _frame(s, al.large_weights(targets), "lang string, weight double").select("lang", F.round("weight", 9).alias("weight"))


def P05_budgets(s: S, d: str) -> DataFrame:
    return _frame(s, al.floored_budgets(al.compact_weights(), TOTAL), "lang string, tokens long")


def P06_budgets_exact(s: S, d: str) -> DataFrame:
    return _frame(s, al.exact_budgets(al.large_weights(sorted(dims.TARGETS_LARGE)), TOTAL_LARGE), "lang string, tokens long")


def P07_byte_budgets(s: S, d: str) -> DataFrame:
    b = _frame(s, al.floored_budgets(al.compact_weights(), TOTAL), "lang string, tokens long")
    return b.select("lang", al.byte_budget(F.col("tokens")).alias("bytes"))


def P08_repo_caps(s: S, d: str) -> DataFrame:
    one = file_values(s, d, "path", "lang", F.octet_length("text").alias("bytes")).where("path IS NOT NULL AND lang IS NOT NULL AND bytes IS NOT NULL")
    per = one.groupBy("lang", cu.repo_of(F.col("path")).alias("repo")).agg(F.sum("bytes").alias("bytes"))
    return al.capped_passes(per, ["lang"], "repo", "bytes", 60_000, ["repo"]).select("lang", "repo", "taken")


def P09_sampling(s: S, d: str) -> DataFrame:
    w = weights(s, d)
    p = al.sampling(F.col("weight"), ~F.coalesce("is_excluded", F.lit(False)), 0.002, 0.5)
    return w.select("lang", F.round(p, 9).alias("p"))


FOLD = 0


def P10_window_weights(s: S, d: str) -> DataFrame:
    """Draw weight of a window: its language's probability by the windows in the fold, by construct boost, 0 outside."""
    p = weights(s, d).select("lang", al.sampling(F.col("weight"), ~F.coalesce("is_excluded", F.lit(False)), 0.002, 0.5).alias("p")).join(table(s, d, "lang_dim").select("lang", "lang_id"), "lang")
    fold = file_folds(s, d).select("lang_id", "file_id", ((F.col("fold") == FOLD) | (F.col("fold") < 0)).alias("in_fold"))
    boost = boosts(s, d)
    w = windows(s, d).where("lang_id IS NOT NULL").join(fold, ["lang_id", "file_id"]).join(boost, ["file_id", "chunk_ix"], "left")
    w = w.withColumn("b", F.when(F.col("in_fold"), F.coalesce("boost", F.lit(1.0))).otherwise(0.0))
    n = w.groupBy("lang_id").agg(F.count("*").alias("windows"), F.sum(F.col("in_fold").cast("long")).alias("in_fold"), F.sum("b").alias("boosts"))
    return n.join(F.broadcast(p), "lang_id").select("lang_id", "windows", "in_fold", F.round(F.col("p") / F.greatest("in_fold", F.lit(1)) * F.col("boosts"), 9).alias("weight"))


DRAWS, SEED = 1000, 7


def P11_weighted_sample(s: S, d: str) -> DataFrame:
    w = windows(s, d).select("win_id", F.greatest("n_labelled", F.lit(1)).cast("long").alias("weight"))
    return al.weighted_sample(w, "win_id", "weight", DRAWS, SEED)


def P12_eval_shards(s: S, d: str) -> DataFrame:
    return windows(s, d).groupBy(al.even_shards(F.col("win_id"), 4).alias("rank")).agg(F.count("*").alias("windows"), F.sum("win_id").alias("checksum"))


def P14_weak_languages(s: S, d: str) -> DataFrame:
    return hits(s, d).where("total > 0").select("lang", F.round(al.weak_multiplier(F.col("hit") / F.col("total")), 9).alias("multiplier"))


def P15_folds(s: S, d: str) -> DataFrame:
    return file_folds(s, d).groupBy("lang_id", "fold").agg(F.count("*").alias("groups"), F.sum("size").alias("windows"))


def P17_demo_pick(s: S, d: str) -> DataFrame:
    """Three files a language in seeded order, those within the size band first."""
    one = file_values(s, d, "lang", F.length("text").alias("chars")).where("lang IS NOT NULL AND chars > 0")
    w = Window.partitionBy("lang").orderBy(F.desc(F.col("chars").between(SHORT_LEAST, SHORT)), F.md5(F.concat(F.lit("7:"), F.col("file_id").cast("string"))), "file_id")
    return one.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("lang", "file_id", "rank")


def P18_stratified(s: S, d: str) -> DataFrame:
    w = Window.partitionBy("lang_id").orderBy(F.md5(F.col("win_id").cast("string")), "win_id")
    return windows(s, d).where("lang_id IS NOT NULL").withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("lang_id", "win_id")


def P20_whole_language_shards(s: S, d: str) -> DataFrame:
    """Languages to the least loaded of four shards, largest first; one row per fixed language."""
    n = windows(s, d).where("lang_id IS NOT NULL").groupBy("lang_id").agg(F.count("*").alias("n")).join(F.broadcast(table(s, d, "lang_dim").select("lang_id")), "lang_id", "left_semi")
    load, rows = [0] * 4, []
    for r in sorted(n.collect(), key=lambda r: (-r["n"], r["lang_id"])):
        at = load.index(min(load))
        load[at] += r["n"]
        rows.append((r["lang_id"], r["n"], at))
    return s.createDataFrame(rows, "lang_id int, n long, shard int")


def T01_by_weight(s: S, d: str) -> DataFrame:
    return weights(s, d).orderBy(F.desc("weight"), "lang").select("lang", F.round("weight", 9).alias("weight"))


def T02_longest(s: S, d: str) -> DataFrame:
    return file_values(s, d, F.length("text").alias("chars")).where("chars IS NOT NULL").orderBy(F.desc("chars"), "file_id").limit(8)


def T03_top_classes(s: S, d: str) -> DataFrame:
    rows = confusion(s, d, "lang").groupBy("lang", "gold").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gold")
    return rows.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("lang", "gold", "n", "rank")


def T04_byte_limit(s: S, d: str) -> DataFrame:
    """Files in order until a language's bytes reach a budget: the last may overshoot."""
    one = file_values(s, d, "lang", "ord", F.octet_length("text").alias("n")).where("lang IS NOT NULL").na.fill(0, ["n"])
    langs = [r[0] for r in table(s, d, "lang_dim").select("lang").collect()]  # fixed: 26 rows
    return cu.budget_cut(one, "lang", "ord", "n", dict.fromkeys(langs, 50_000)).select("lang", "file_id", "n")


def U01_language_union(s: S, d: str) -> DataFrame:
    a = one_per_file(s, d, "lang").select("lang")
    return a.union(table(s, d, "lang_dim").select("lang")).where("lang IS NOT NULL").distinct()


def U02_repo_union(s: S, d: str) -> DataFrame:
    """Repository names of catalogue and forks, each where it first stands."""
    r = table(s, d, "repos")
    rows = r.select(F.explode(F.array(F.struct(F.col("repo_id"), F.lit(0).alias("k"), F.col("slug").alias("x")), F.struct(F.col("repo_id"), F.lit(1).alias("k"), F.col("parent_slug").alias("x")))).alias("e")).select("e.*")
    return rows.where("x IS NOT NULL").groupBy(_repo_key(F.col("x")).alias("repo")).agg(F.min(F.col("repo_id") * 2 + F.col("k")).alias("first"))


def U03_unmapped(s: S, d: str) -> DataFrame:
    names = one_per_file(s, d, "lang").where("lang IS NOT NULL").select(F.lower("lang").alias("lang")).distinct()
    return names.join(F.broadcast(aliases(s, d).select(F.col("alias").alias("lang"))), "lang", "left_anti")


def U04_shared_shapes(s: S, d: str) -> DataFrame:
    """Fingerprints that train shares with other splits."""
    w = windows(s, d)
    return w.where("split = 'train'").select("shape_fp").intersect(w.where("split <> 'train'").select("shape_fp"))


_WIN = "win AS (SELECT win_id, max(file_id) AS file_id, max(chunk_ix) AS chunk_ix, max(repo) AS repo, max(lang_id) AS lang_id, max(split) AS split, max(tok_from) AS tok_from, max(tok_to) AS tok_to, max(n_labelled) AS n_labelled, max(shape_fp) AS shape_fp FROM windows GROUP BY win_id)"
_OW = _WIN + ", fo AS (SELECT file_id, max(ord) AS ord FROM files GROUP BY file_id), ow AS (SELECT win.*, tok_to - tok_from AS n, ord FROM win JOIN fo USING (file_id) WHERE lang_id IS NOT NULL)"
_FOLDS = """g0 AS (SELECT lang_id, file_id, count(*) AS size FROM win WHERE lang_id IS NOT NULL GROUP BY ALL), gn AS (SELECT *, count(*) OVER (PARTITION BY lang_id) AS n, row_number() OVER (PARTITION BY lang_id ORDER BY size DESC, file_id) AS k FROM g0),
 st(lang_id, k, l0, l1, fold) AS (SELECT DISTINCT lang_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, -1 FROM gn UNION ALL SELECT s.lang_id, s.k + 1, l0 + CASE WHEN l0 <= l1 THEN size ELSE 0 END, l1 + CASE WHEN l0 <= l1 THEN 0 ELSE size END, CASE WHEN l0 <= l1 THEN 0 ELSE 1 END FROM st s JOIN gn ON gn.lang_id = s.lang_id AND gn.k = s.k + 1),
 fo2 AS (SELECT gn.lang_id, file_id, size, CASE WHEN n < 4 THEN -1 ELSE fold END AS fold FROM gn JOIN st ON gn.lang_id = st.lang_id AND gn.k = st.k)"""
_AL = "al AS (SELECT alias, min(lang) AS lang FROM (SELECT lower(unnest(list_concat([lang], coalesce(aliases, [])))) AS alias, lang FROM lang_dim) GROUP BY alias)"
_LL = "ll AS (SELECT line_no, max(path) AS path, max(rle) AS rle, max(shard) AS shard FROM label_lines WHERE rle IS NOT NULL AND rle <> '' GROUP BY line_no)"
_W = "w AS (SELECT lang, coalesce(pusher_share, 0.25) / sum(coalesce(pusher_share, 0.25)) OVER () AS weight, coalesce(is_excluded, false) AS ex FROM lang_dim)"
_BASE = r"string_split_regex(path, '[/\\]')[-1]"
_LAST = f"string_split({_BASE}, '__')[-1]"
_EXT = f"CASE WHEN contains({_LAST}, '.') THEN '.' || lower(string_split({_LAST}, '.')[-1]) ELSE '' END"
_BAD = " OR ".join(f"(lang = '{k}' AND {_EXT} IN ({', '.join(repr(x) for x in v)}))" for k, v in dims.MISMATCHED.items())
_REPO = f"CASE WHEN len(string_split({_BASE}, '__')) > 2 THEN array_to_string(string_split({_BASE}, '__')[1:2], '__') ELSE '?' END"
_STRIP = f"length(regexp_replace(text, '^{cu.BLANKS}+|{cu.BLANKS}+$', '', 'g'))"
_KEY = lambda c: f"regexp_replace(lower(trim({c})), '\\.git$', '')"
_KX = "k AS (SELECT *, row_number() OVER (PARTITION BY line_no, file_id ORDER BY ix) - 1 AS kx FROM al WHERE kind IN (0, 3))"


def _sql_weights(values: dict[str, float]) -> str:
    return ", ".join(f"('{k}', {v!r})" for k, v in values.items())


_RAW = {lang: dims.PUSHER_SHARE.get(lang, dims.TAIL_SHARE) for lang in dims.TARGETS}
_COMPACT = f"c0 AS (SELECT * FROM (VALUES {_sql_weights(_RAW)}) AS t(lang, share)), c AS (SELECT lang, share::DOUBLE / sum(share::DOUBLE) OVER () AS weight FROM c0)"
_LARGE = f"g0 AS (SELECT * FROM (VALUES {_sql_weights({x: dims.POPULARITY.get(x, dims.POPULARITY_REST) for x in dims.TARGETS_LARGE})}) AS t(lang, share)), g AS (SELECT lang, 0.75 * share::DOUBLE / sum(share::DOUBLE) OVER () + 0.25 / count(*) OVER () AS weight FROM g0)"
_BUD = f"b AS (SELECT lang, greatest(400000, floor(sqrt(weight) * ({TOTAL} / (SELECT sum(sqrt(weight)) FROM c))))::BIGINT AS tokens FROM c)"
_P = "sm AS (SELECT lang, CASE WHEN ex THEN 0 ELSE pow(greatest(weight, 0.002), 0.5) END AS q FROM w), pr AS (SELECT lang, q / sum(q) OVER () AS p FROM sm)"


def _sql_repair() -> str:
    step = """{o} AS (SELECT lang_id, greatest(1, count_if(split = 'train') // 20) AS quota FROM {i} GROUP BY lang_id HAVING count_if(split = '{m}') = 0 AND count_if(split = 'train') > 0),
      {r} AS (SELECT x.win_id, x.lang_id, x.ord, x.chunk_ix, CASE WHEN x.split = 'train' AND quota IS NOT NULL AND row_number() OVER (PARTITION BY x.lang_id, x.split ORDER BY ord, chunk_ix, win_id) <= quota THEN '{m}' ELSE x.split END AS split FROM {i} x LEFT JOIN {o} ON x.lang_id = {o}.lang_id)"""
    return step.format(i="ow", o="q1", r="r1", m="val") + ", " + step.format(i="r1", o="q2", r="r2", m="test")


def _sql_caps() -> str:
    sql = f"o AS (SELECT lang, {_REPO} AS repo, sum(strlen(text))::BIGINT AS bytes FROM f WHERE path IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL GROUP BY ALL), t0 AS (SELECT *, 60000 // count(*) OVER (PARTITION BY lang) AS share, 0::BIGINT AS taken FROM o)"
    for i, limit in enumerate(("greatest(share * 2, 1500000)", "greatest(share * 2, 1500000) * 3", None)):
        room = "bytes - taken" if limit is None else f"greatest(0, least(bytes, {limit}) - taken)"
        sql += f", u{i} AS (SELECT *, 60000 - sum(taken) OVER (PARTITION BY lang) AS lft, {room} AS room FROM t{i}), t{i + 1} AS (SELECT lang, repo, bytes, share, (taken + greatest(0, least(room, lft - coalesce(sum(room) OVER (PARTITION BY lang ORDER BY repo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken FROM u{i})"
    return sql


SQL = {
    "S02_label_shards": rf"WITH {_LL}, x AS (SELECT *, CASE WHEN len(string_split_regex(path, '[/\\]')) >= 2 THEN string_split_regex(path, '[/\\]')[-2] END AS lang FROM ll WHERE path IS NOT NULL) SELECT shard, count(*) AS lines, count_if({_BAD})::BIGINT AS skipped FROM x WHERE lang IN (SELECT lang FROM lang_dim) GROUP BY shard",
    "S06_denylist": f"WITH {SQL_FILES} SELECT DISTINCT sha256(text) AS digest FROM f WHERE lower(trim(split)) = 'test' AND text IS NOT NULL",
    "S07_popularity": "WITH t AS (SELECT lang, pusher_share FROM lang_dim WHERE pusher_share IS NOT NULL ORDER BY pusher_share DESC, lang LIMIT 25) SELECT lang, round(pusher_share / sum(pusher_share) OVER (), 9) AS weight FROM t",
    "S13_manifest": f"WITH {SQL_FILES}, k AS (SELECT regexp_replace(lower(lang), '[^a-z0-9]', '', 'g') AS k, lang, 1 AS r FROM lang_dim UNION ALL SELECT regexp_replace(lower(x), '[^a-z0-9]', '', 'g'), lang, 3 FROM (SELECT unnest(aliases) AS x, lang FROM lang_dim) UNION ALL SELECT CASE lang WHEN 'shell' THEN 'shellscript' ELSE regexp_replace(lower(lang), '[^a-z0-9]', '', 'g') END, lang, 2 FROM lang_dim), b AS (SELECT k, arg_min(lang, (r, lang)) AS found FROM k WHERE k <> '' GROUP BY k), n AS (SELECT DISTINCT lang FROM f WHERE lang IS NOT NULL AND lang NOT IN ('erlang-repl', 'julia-repl', 'python-repl', 'clojure-repl', 'node-repl', 'php-template', 'xl', 'excel')) SELECT n.lang, found, CASE WHEN found IN ({", ".join(f"'{t}'" for t in dims.TARGETS)}) THEN 'first' WHEN found IS NOT NULL THEN 'second' END AS engine FROM n LEFT JOIN b ON b.k = regexp_replace(lower(n.lang), '[^a-z0-9]', '', 'g')",
    "S14_reuse": f"WITH {SQL_FILES}, {_AL}, {_WIN} SELECT al.lang, count(*) AS files FROM f JOIN al ON lower(f.lang) = al.alias WHERE file_id NOT IN (SELECT file_id FROM win WHERE file_id IS NOT NULL) GROUP BY al.lang",
    "K01_label_lines": "WITH t AS (SELECT line_no, max(path) AS path, max(rle) AS rle, max(shard) AS shard FROM label_lines GROUP BY line_no), o AS (SELECT *, path IS NOT NULL AND coalesce(rle, '') <> '' AS ok FROM t) SELECT shard, count_if(ok)::BIGINT AS written, count_if(NOT ok)::BIGINT AS dropped, sum(CASE WHEN ok THEN length(path) + length(rle) + 2 ELSE 0 END)::BIGINT AS chars FROM o GROUP BY shard",
    "K03_split_cache": f"WITH {_WIN} SELECT split, count(*) AS windows, sum(tok_to - tok_from)::BIGINT AS tokens, count(DISTINCT file_id) AS files FROM win GROUP BY split",
    "K04_meta": f"WITH {_WIN}, {_W} SELECT count(*) AS windows, sum(tok_to - tok_from)::BIGINT AS tokens, count(DISTINCT lang_id) AS languages, count(DISTINCT shape_fp) AS shapes, (SELECT round(sum(CASE WHEN lang_id IN (SELECT lang_id FROM win) THEN weight ELSE 0 END), 9) FROM w JOIN lang_dim USING (lang)) AS coverage, (SELECT count_if(ex) FROM w)::BIGINT AS excluded, 2 AS feature_version, {TOTAL}::BIGINT AS requested FROM win",
    "K06_provenance": f"WITH {SQL_FILES} SELECT lang, count(*) AS files, sum(strlen(text))::BIGINT AS bytes, count(DISTINCT sha256(text)) AS texts FROM f GROUP BY lang",
    "K07_checksums": f"WITH {SQL_FILES} SELECT file_id, sha256(text) AS digest FROM f",
    "F01_paths": rf"WITH {SQL_FILES}, {_AL}, x AS (SELECT al.lang, f.path, d.file_exts FROM f JOIN al ON lower(f.lang) = al.alias JOIN lang_dim d ON d.lang = al.lang WHERE path IS NOT NULL), o AS (SELECT lang, coalesce(NOT regexp_matches(replace(path, '\', '/'), '{dims.SKIP_PATH}') AND NOT regexp_matches({_BASE}, '{dims.SKIP_NAME}') AND len(list_filter(file_exts, lambda e: ends_with(lower({_BASE}), e))) > 0, false) AS ok, regexp_matches(lower({_BASE}), '^(dockerfile|license|authors|notice|copying|contributors|changelog|makefile|gnumakefile|cmakelists\.txt|build|workspace)($|\.)') AS st FROM x) SELECT lang, count_if(ok)::BIGINT AS kept, count_if(NOT ok)::BIGINT AS dropped, count_if(st)::BIGINT AS by_stem FROM o GROUP BY lang",
    "F02_size_band": f"WITH {SQL_FILES} SELECT lang, strlen(text) BETWEEN 200 AND 400000 AND NOT contains(text, chr(0)) AND {_STRIP} >= 200 AS ok, count(*) AS files FROM f GROUP BY ALL",
    "F03_truncate": f"WITH {SQL_FILES}, x AS (SELECT file_id, text, length(text) > {SHORT} AS cut, length(regexp_extract(left(text, {SHORT}), '(?s)^(.*)\\n', 1)) AS nl FROM f), y AS (SELECT file_id, cut, CASE WHEN cut THEN left(text, CASE WHEN nl > {SHORT_LEAST} THEN nl ELSE {SHORT} END) ELSE text END AS t FROM x) SELECT file_id, length(t)::INT AS chars, md5(t) AS digest, cut FROM y",
    "F04_dialects": f"WITH {SQL_FILES} SELECT lang, count_if(NOT ({_BAD}))::BIGINT AS kept, count(*) AS files FROM f WHERE path IS NOT NULL AND lang IS NOT NULL GROUP BY lang",
    "F05_denylist": f"WITH {SQL_FILES}, x AS (SELECT file_id, lower(trim(split)) AS split, sha256(text) AS digest FROM f) SELECT file_id, split FROM x WHERE split <> 'test' AND digest IS NOT NULL AND digest NOT IN (SELECT digest FROM x WHERE split = 'test' AND digest IS NOT NULL)",
    "F06_file_gate": f"WITH {SQL_LABELLED}, g2 AS (SELECT line_no, file_id, lang, count(*) >= 32 AND count(label) >= 16 AS ok FROM al WHERE kind IN (0, 3) GROUP BY ALL) SELECT lang, count_if(ok)::BIGINT AS kept, count_if(NOT ok)::BIGINT AS dropped FROM g2 GROUP BY lang",
    "F07_chunk_gate": f"WITH {SQL_LABELLED}, {_KX}, g2 AS (SELECT line_no, file_id, (kx // 512)::INT AS chunk_ix, count(*) AS n, count(*) >= 32 AND count(label) >= 16 AS ok FROM k GROUP BY ALL) SELECT chunk_ix, count_if(ok)::BIGINT AS kept, count_if(NOT ok)::BIGINT AS dropped, coalesce(sum(n) FILTER (ok), 0)::BIGINT AS tokens FROM g2 GROUP BY chunk_ix",
    "F08_repos": f"WITH {SQL_FILES} SELECT {_REPO} AS repo, count(*) AS files FROM f WHERE path IS NOT NULL GROUP BY ALL",
    "F09_names": rf"WITH {SQL_FILES}, x AS (SELECT file_id, regexp_replace(regexp_replace(path, '[/\\]', '_', 'g'), '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM f WHERE path IS NOT NULL), y AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file_id) AS n FROM x) SELECT file_id, CASE WHEN n = 1 THEN name ELSE name || '-' || n END AS name FROM y",
    "F10_aliases": f"""WITH {SQL_FILES}, y AS (SELECT lower(lang) AS y FROM f), c AS (SELECT 'compact' AS target, CASE y WHEN 'makefile' THEN 'make' WHEN 'batchfile' THEN 'bat' WHEN 'plpgsql' THEN 'sql' WHEN 'objective-c' THEN 'objc' WHEN 'assembly' THEN 'asm' WHEN 'procfile' THEN 'shell' ELSE y END AS x FROM y),
      l AS (SELECT 'large' AS target, CASE y WHEN 'assembly' THEN 'x86asm' WHEN 'batchfile' THEN 'dos' WHEN 'emacs-lisp' THEN 'lisp' WHEN 'html' THEN 'xml' WHEN 'objective-c' THEN 'objectivec' WHEN 'objective-cpp' THEN 'objectivec' WHEN 'objc' THEN 'objectivec' WHEN 'plpgsql' THEN 'pgsql' WHEN 'shell' THEN 'bash' WHEN 'shellscript' THEN 'bash'
        WHEN 'make' THEN 'makefile' WHEN 'systemverilog' THEN 'verilog' WHEN 'tsql' THEN 'sql' WHEN 'vb' THEN 'vbnet' WHEN 'vim-script' THEN 'vim' WHEN 'webassembly' THEN 'wasm' WHEN 'xslt' THEN 'xml' ELSE y END AS x FROM y)
      SELECT target, CASE WHEN x IN (SELECT t FROM (VALUES {", ".join(f"('{t}')" for t in dims.TARGETS)}) v(t)) THEN x END AS lang, count(*) AS files FROM c GROUP BY ALL UNION ALL SELECT target, CASE WHEN x IN (SELECT t FROM (VALUES {", ".join(f"('{t}')" for t in dims.TARGETS_LARGE)}) v(t)) THEN x END, count(*) FROM l GROUP BY ALL""",
    "F11_grammars": f"""WITH n AS (SELECT lang FROM lang_dim WHERE lang IS NOT NULL UNION SELECT t FROM (VALUES {", ".join(f"('{t}')" for t in dims.TARGETS)}) v(t) UNION SELECT unnest(['plaintext', 'tsql']))
      SELECT lang, CASE lang WHEN 'shell' THEN 'shellscript' WHEN 'plaintext' THEN 'txt' WHEN 'objcpp' THEN 'objective-cpp' WHEN 'tsql' THEN 'sql' WHEN 'starlark' THEN 'python' WHEN 'smarty' THEN 'html' WHEN 'xslt' THEN 'xml' WHEN 'm4' THEN 'shellscript' WHEN 'lex' THEN 'c' WHEN 'yacc' THEN 'c' WHEN 'qmake' THEN 'make' ELSE lang END AS grammar FROM n""",
    "F12_valid_utf8": f"""WITH {SQL_FILES}, b AS (SELECT file_id, encode(text) AS b, strlen(text) AS n FROM f), k AS (SELECT file_id, count(*) AS blocks, count_if(NOT (hex(b[i:i]) BETWEEN '80' AND 'BF' OR (i + {BLOCK} <= n AND hex(b[i + {BLOCK}:i + {BLOCK}]) BETWEEN '80' AND 'BF'))) AS valid FROM (SELECT file_id, b, n, unnest(range(1, n + 1, {BLOCK})) AS i FROM b) GROUP BY file_id)
      SELECT CASE WHEN b IS NULL THEN NULL ELSE true END AS whole, count(*) AS files, sum(CASE WHEN b IS NOT NULL THEN coalesce(blocks, 0) END)::BIGINT AS blocks, sum(CASE WHEN b IS NOT NULL THEN coalesce(valid, 0) END)::BIGINT AS valid FROM b LEFT JOIN k USING (file_id) GROUP BY ALL""",
    "F13_policy": f"WITH {_W} SELECT lang, round(weight, 9) AS weight, ex AS excluded FROM w",
    "F14_not_excluded": f"WITH {SQL_FILES} SELECT lang, count(*) AS files FROM f WHERE lang IS NOT NULL AND lang NOT IN (SELECT lang FROM lang_dim WHERE is_excluded) GROUP BY lang",
    "J03_labelled_files": f"WITH {SQL_FILES}, {_LL} SELECT lang, count(*) AS files FROM f WHERE path IN (SELECT path FROM ll WHERE path IS NOT NULL) GROUP BY lang",
    "J04_language_ids": f"WITH {SQL_FILES} SELECT lang_id, count(*) AS files FROM f JOIN lang_dim USING (lang) GROUP BY lang_id",
    "J06_repo_overlap": f"WITH {_WIN}, c AS (SELECT DISTINCT replace({_KEY('slug')}, '/', '__') AS repo FROM repos WHERE slug IS NOT NULL), m AS (SELECT DISTINCT {_KEY('repo')} AS repo FROM win WHERE repo IS NOT NULL AND repo <> '?') SELECT m.repo, c.repo IS NOT NULL AS known FROM m LEFT JOIN c USING (repo)",
    "J07_logits": f"WITH {_WIN}, e AS (SELECT vec_id, list_sum(any_value(embedding)::DOUBLE[]) AS t FROM embeddings WHERE embedding IS NOT NULL GROUP BY vec_id) SELECT split, count(*) AS windows, count(t) AS with_logits, round(sum(t), 4) AS total FROM (SELECT *, row_number() OVER (ORDER BY win_id) - 1 AS win_ix FROM win) LEFT JOIN e ON vec_id = win_ix GROUP BY split",
    "J08_fold_mix": f"""WITH RECURSIVE {_WIN}, {_FOLDS}, e AS (SELECT vec_id, any_value(embedding)::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL GROUP BY vec_id),
      m AS (SELECT win_id, fold, c, CASE fold WHEN 0 THEN v[10 + c] WHEN 1 THEN v[1 + c] ELSE (v[1 + c] + v[10 + c]) / 2 END AS x FROM (SELECT *, row_number() OVER (ORDER BY win_id) - 1 AS win_ix FROM win) w2 JOIN fo2 USING (lang_id, file_id) JOIN e ON vec_id = win_ix, range(9) t(c))
      SELECT win_id, fold::INT AS fold, arg_max(c, (x, -c))::INT AS cls, round(max(x), 6) AS top FROM m GROUP BY win_id, fold""",
    "J09_reference_cases": f"WITH {SQL_GOLD} SELECT file_id, count(*) AS n, count_if(gold = pred)::BIGINT AS same, coalesce(min(ix) FILTER (gold <> pred), -1)::INT AS first_diff FROM gold WHERE gold >= 0 GROUP BY file_id",
    "W08_file_groups": f"WITH {_WIN}, x AS (SELECT win_id, lang_id, tok_to - tok_from AS n FROM win), y AS (SELECT win_id, lag(win_id) OVER w IS NULL OR lag(n) OVER w < 512 OR lag(lang_id) OVER w IS DISTINCT FROM lang_id AS new FROM x WINDOW w AS (ORDER BY win_id)) SELECT win_id, (sum(new::INT) OVER (ORDER BY win_id) - 1)::BIGINT AS group_id FROM y",
    "W09_chunks": f"WITH {SQL_LABELLED}, {_KX}, c AS (SELECT line_no, file_id, (kx // 512)::INT AS chunk_ix, count(*) AS n FROM k GROUP BY ALL) SELECT chunk_ix, n = 512 AS whole, count(*) AS chunks FROM c GROUP BY ALL",
    "W10_dup_cap": f"WITH {_OW}, r AS (SELECT win_id, shape_fp, row_number() OVER (PARTITION BY shape_fp ORDER BY ord, chunk_ix, win_id) AS r FROM ow) SELECT win_id, shape_fp FROM r WHERE r <= 3",
    "W11_budget_cut": f"WITH {_OW}, p AS (SELECT lang_id, ord, sum(n)::BIGINT AS n FROM ow GROUP BY ALL), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p) SELECT lang_id, ord, n FROM r WHERE b < (SELECT sum(n) // (2 * (SELECT count(*) FROM lang_dim)) FROM ow) AND lang_id IN (SELECT lang_id FROM lang_dim)",
    "P01_split": f"WITH {SQL_FILES}, x AS (SELECT file_id, concat('0x', substr(sha1(text), 1, 8))::BIGINT % 100 AS b FROM f WHERE text IS NOT NULL) SELECT file_id, CASE WHEN b < 5 THEN 'test' WHEN b < 10 THEN 'val' ELSE 'train' END AS split FROM x",
    "P02_split_repair": f"WITH {_OW}, {_sql_repair()} SELECT lang_id, split, count(*) AS windows, sum(win_id)::BIGINT AS checksum FROM r2 GROUP BY ALL",
    "P03_weights": f"WITH {_COMPACT} SELECT lang, round(weight, 9) AS weight FROM c",
    "P04_weights_large": f"WITH {_LARGE} SELECT lang, round(weight, 9) AS weight FROM g",
    "P05_budgets": f"WITH {_COMPACT}, {_BUD} SELECT lang, tokens FROM b",
    "P06_budgets_exact": f"WITH {_LARGE}, q AS (SELECT lang, sqrt(weight) AS s FROM g), z AS (SELECT lang, s, 300000 + floor(({TOTAL_LARGE} - 300000 * (SELECT count(*) FROM q)) * s / (SELECT sum(s) FROM q))::BIGINT AS t FROM q), k AS (SELECT *, row_number() OVER (ORDER BY s DESC, lang) AS r, {TOTAL_LARGE} - sum(t) OVER () AS missing FROM z) SELECT lang, (t + (r <= missing)::INT)::BIGINT AS tokens FROM k",
    "P07_byte_budgets": f"WITH {_COMPACT}, {_BUD} SELECT lang, floor(tokens * 2.5)::BIGINT AS bytes FROM b",
    "P08_repo_caps": f"WITH {SQL_FILES}, {_sql_caps()} SELECT lang, repo, taken FROM t3",
    "P09_sampling": f"WITH {_W}, {_P} SELECT lang, round(p, 9) AS p FROM pr",
    "P10_window_weights": f"""WITH RECURSIVE {_W}, {_P}, {_WIN}, {_FOLDS}, {SQL_CONSTRUCTS}, bo AS (SELECT file_id, win AS chunk_ix, max(1 + 0.5 * least(1.0, complete / 2)) AS boost FROM c GROUP BY ALL),
      n AS (SELECT win.lang_id, count(*) AS windows, count_if(fold IN (0, -1)) AS in_fold, sum(CASE WHEN fold IN (0, -1) THEN coalesce(boost, 1) ELSE 0 END) AS boosts FROM win JOIN fo2 ON win.lang_id = fo2.lang_id AND win.file_id = fo2.file_id LEFT JOIN bo ON bo.file_id = win.file_id AND bo.chunk_ix = win.chunk_ix GROUP BY win.lang_id)
      SELECT lang_id, windows, in_fold::BIGINT AS in_fold, round(p / greatest(in_fold, 1) * boosts, 9) AS weight FROM n JOIN lang_dim USING (lang_id) JOIN pr USING (lang)""",
    "P11_weighted_sample": f"""WITH {_WIN}, x AS (SELECT win_id, greatest(coalesce(n_labelled, 1), 1)::BIGINT AS w FROM win), c AS (SELECT win_id, (sum(w) OVER (ORDER BY win_id) - w)::BIGINT AS lo, (sum(w) OVER ())::BIGINT AS total FROM x),
      u AS (SELECT ('0x' || substr(md5('{SEED}:' || i), 1, 15))::BIGINT % (SELECT max(total) FROM c) AS u FROM range({DRAWS}) t(i)) SELECT win_id, count(*) AS times FROM u ASOF JOIN c ON u >= lo GROUP BY win_id""",
    "P15_folds": f"WITH RECURSIVE {_WIN}, {_FOLDS} SELECT lang_id, fold::INT AS fold, count(*) AS groups, sum(size)::BIGINT AS windows FROM fo2 GROUP BY ALL",
    "P20_whole_language_shards": f"""WITH RECURSIVE {_WIN}, n AS (SELECT lang_id, count(*) AS n FROM win WHERE lang_id IN (SELECT lang_id FROM lang_dim) GROUP BY lang_id), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, lang_id) AS k FROM n),
      s(k, l, lang_id, n, shard) AS (SELECT 0::BIGINT, [0, 0, 0, 0]::BIGINT[], NULL::INT, NULL::BIGINT, -1 UNION ALL SELECT o.k, list_transform(l, lambda x, i: x + CASE WHEN i = list_position(l, list_min(l)) THEN o.n ELSE 0 END), o.lang_id, o.n, list_position(l, list_min(l)) - 1 FROM s JOIN o ON o.k = s.k + 1)
      SELECT lang_id, n, shard::INT AS shard FROM s WHERE k > 0""",
    "P12_eval_shards": f"WITH {_WIN} SELECT (win_id % 4)::INT AS rank, count(*) AS windows, sum(win_id)::BIGINT AS checksum FROM win GROUP BY ALL",
    "P14_weak_languages": f"WITH {SQL_GOLD}, h AS (SELECT lang, count_if(gold = pred) / count(*) AS a FROM gold WHERE gold >= 0 AND lang IS NOT NULL GROUP BY lang) SELECT lang, round(least(3.0::DOUBLE, greatest(0.5::DOUBLE, 2 - 2 * a)), 9) AS multiplier FROM h",
    "P17_demo_pick": f"WITH {SQL_FILES}, x AS (SELECT lang, file_id, row_number() OVER (PARTITION BY lang ORDER BY (length(text) BETWEEN {SHORT_LEAST} AND {SHORT}) DESC, md5('7:' || file_id), file_id)::INT AS rank FROM f WHERE lang IS NOT NULL AND length(text) > 0) SELECT * FROM x WHERE rank <= 3",
    "P18_stratified": f"WITH {_WIN}, x AS (SELECT lang_id, win_id, row_number() OVER (PARTITION BY lang_id ORDER BY md5(win_id::VARCHAR), win_id) AS r FROM win WHERE lang_id IS NOT NULL) SELECT lang_id, win_id FROM x WHERE r <= 5",
    "T01_by_weight": f"WITH {_W} SELECT lang, round(weight, 9) AS weight FROM w ORDER BY weight DESC, lang",
    "T02_longest": f"WITH {SQL_FILES} SELECT file_id, length(text)::INT AS chars FROM f WHERE text IS NOT NULL ORDER BY chars DESC, file_id LIMIT 8",
    "T03_top_classes": f"WITH {SQL_GOLD}, c AS (SELECT lang, gold, count(*) AS n FROM gold WHERE gold >= 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gold)::INT AS rank FROM c) SELECT * FROM r WHERE rank <= 3",
    "T04_byte_limit": f"WITH {SQL_FILES}, x AS (SELECT lang, file_id, coalesce(strlen(text), 0)::INT AS n, coalesce(sum(coalesce(strlen(text), 0)) OVER (PARTITION BY lang ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM f) SELECT lang, file_id, n FROM x WHERE b < 50000 AND lang IN (SELECT lang FROM lang_dim)",
    "U01_language_union": "SELECT lang FROM files WHERE lang IS NOT NULL UNION SELECT lang FROM lang_dim WHERE lang IS NOT NULL",
    "U02_repo_union": f"WITH x AS (SELECT repo_id * 2 AS o, slug AS x FROM repos UNION ALL SELECT repo_id * 2 + 1, parent_slug FROM repos) SELECT {_KEY('x')} AS repo, min(o) AS first FROM x WHERE x IS NOT NULL GROUP BY ALL",
    "U03_unmapped": f"WITH {_AL} SELECT DISTINCT lower(lang) AS lang FROM files WHERE lang IS NOT NULL AND lower(lang) NOT IN (SELECT alias FROM al)",
    "U04_shared_shapes": f"WITH {_WIN} SELECT shape_fp FROM win WHERE split = 'train' INTERSECT SELECT shape_fp FROM win WHERE split <> 'train'",
}
QUERIES = {k: v for k, v in globals().items() if k[:1] in "SKFJWPTU" and k[1:3].isdigit()}
