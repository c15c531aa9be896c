"""Curation: filters on paths and texts, duplicate cap, budgets, split repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codegrain import dims
from codegrain.operators.durable import durable
from codegrain.operators.ordered import running_sum


def base_name(path: Column) -> Column:
    """Last part of a path, with either slash."""
    return F.element_at(F.split(path, r"[/\\]"), -1)


def wanted_path(path: Column, extensions: Column, stems: Column | None = None) -> Column:
    """Whether a path is a source file of a language with these extensions or stems, outside skipped folders."""
    flat = F.regexp_replace(path, r"\\", "/")
    name = base_name(path)
    mine = F.exists(extensions, lambda e: F.endswith(F.lower(name), e))
    if stems is not None:
        mine = mine | F.exists(stems, lambda s: (F.lower(name) == s) | F.startswith(F.lower(name), F.concat(s, F.lit("."))))
    return ~flat.rlike(dims.SKIP_PATH) & ~name.rlike(dims.SKIP_NAME) & mine


def stems_of(lang: Column) -> Column:
    """File-name stems of a language, an empty array for most."""
    rules = F.create_map(*[x for k, v in dims.STEMS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    return F.coalesce(F.try_element_at(rules, lang), F.array().cast("array<string>"))


def target_of(family: Column, large: bool) -> Column:
    """The target language that a family of delivered shards is read as; null if it is to be dropped."""
    rules = dims.FAMILIES_LARGE | dims.FAMILIES_IMPORT if large else dims.FAMILIES
    targets = dims.TARGETS_LARGE if large else dims.TARGETS
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in rules.items() for x in kv]), family), family)
    return F.when(name.isin(*targets), name)


def grammar_of(lang: Column) -> Column:
    """Grammar id of a language; its own name where none differs."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in dims.GRAMMARS.items() for x in kv]), lang), lang)


#: What counts as blank when a text is stripped.
BLANKS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def stripped_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"^{BLANKS}+|{BLANKS}+$", ""))


def in_band(text: Column, least: int = 200, most: int = 400_000) -> Column:
    """Size in bytes within the band, no NUL, and not almost blank."""
    return F.octet_length(text).between(least, most) & ~text.contains("\x00") & (stripped_length(text) >= least)


def truncate(text: Column, limit: int = 30_000, least: int = 200) -> Column:
    """Texts over the limit cut at the last line end before it if that lies beyond ``least``, else hard."""
    head = F.substring(text, 1, limit)
    last = F.lit(limit) - F.instr(F.reverse(head), "\n")  # index of the last line end; the limit if none
    cut = F.when((last < limit) & (last > least), last).otherwise(limit)
    return F.when(F.length(text) > limit, F.substring(text, F.lit(1), cut)).otherwise(text)


def dialect_ok(lang: Column, path: Column) -> Column:
    """False for extensions that the language's grammar would label wrongly."""
    last = F.element_at(F.split(base_name(path), "__"), -1)
    ext = F.when(last.contains("."), F.concat(F.lit("."), F.lower(F.element_at(F.split(last, r"\."), -1)))).otherwise("")
    bad = F.lit(False)
    for name, exts in dims.MISMATCHED.items():
        bad = bad | ((lang == name) & ext.isin(*exts))
    return ~bad


def repo_of(path: Column) -> Column:
    """First two ``__`` parts of the file name, ``?`` where there are not more than two."""
    parts = F.split(base_name(path), "__")
    return F.when(F.size(parts) > 2, F.concat_ws("__", F.slice(parts, 1, 2))).otherwise("?")


def flat_name(path: Column) -> Column:
    """A path as one safe file name."""
    return F.regexp_replace(F.regexp_replace(path, r"[/\\]", "_"), r"[^A-Za-z0-9._-]+", "_")


def cap_duplicates(df: DataFrame, fingerprint: str, order: list[str], most: int = 3) -> DataFrame:
    """The first ``most`` rows of each fingerprint; the limit is applied before the shuffle as well."""
    w = Window.partitionBy(fingerprint).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= most).drop("__rank")


def order_key(df: DataFrame, col: str) -> DataFrame:
    """``df`` with ``__key``, ``col`` stretched over the range of 64-bit hashes, order kept (not strictly)."""
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    step = (1 << 62) // max((hi or 0) - (lo or 0) + 1, 2)
    # kept in range, as the key may be computed of rows that a filter behind it drops
    within = F.least(F.greatest(F.col(col), F.lit(lo or 0)), F.lit(hi or 0))
    return df.withColumn("__key", (within - F.lit(lo or 0)) * F.lit(step) * 2 - F.lit(1 << 62))


def budget_cut(files: DataFrame, lang: str, order: str, size: str, budgets: dict) -> DataFrame:
    """Files kept while their language's running total before them is under its budget.

    ``budgets`` is small (one entry per language).  A language without a budget keeps nothing.  The running
    total is spread over cells, so a language may hold any share of the files.
    """
    spark = files.sparkSession
    kind = files.schema[lang].dataType.simpleString()
    files = durable(files, "budget-files")  # light rows, read several times below
    plan = spark.createDataFrame(list(budgets.items()), f"`{lang}` {kind}, __budget long")
    run = running_sum(order_key(files, order), [lang], "__key", [order], {"__before": size})
    return run.join(F.broadcast(plan), lang).where("__before < __budget").drop("__before", "__budget", "__key")


def build(chunks: DataFrame, lang: str, order: str, chunk: str, fingerprint: str, size: str, budgets: dict, most: int = 3) -> tuple[DataFrame, int]:
    """Duplicate cap and budgets applied as one ordered pass would, and the number of rounds.

    A file skipped for its budget does not count towards duplicates, and what is kept depends on the
    duplicates of all languages.  Within a language everything behind one point of the order is skipped, so
    the state is one cutoff per language: rank duplicates below the cutoffs, recompute them, repeat.  The
    earliest cutoff is right after one round, the next after two, so rounds are at most the languages plus 1.
    """
    spark = chunks.sparkSession
    kind = chunks.schema[lang].dataType.simpleString()
    base = durable(chunks.select(lang, order, chunk, fingerprint, size), "build-chunks")
    far = (1 << 62) - 1
    cut = dict.fromkeys(budgets, far)
    rounds = 0
    while True:
        rounds += 1
        now = spark.createDataFrame(list(cut.items()), f"`{lang}` {kind}, __cut long")
        kept = cap_duplicates(base.join(F.broadcast(now), lang).where(F.col(order) < F.col("__cut")).drop("__cut"), fingerprint, [order, chunk], most)
        # every file has its turn, also one of which nothing is kept
        got = kept.groupBy(lang, order).agg(F.sum(size).alias("__n"))
        turns = durable(base.select(lang, order).distinct().join(got, [lang, order], "left").na.fill(0, ["__n"]), "build-turns")
        run = running_sum(order_key(turns, order), [lang], "__key", [order], {"__before": "__n"})
        plan = spark.createDataFrame(list(budgets.items()), f"`{lang}` {kind}, __budget long")
        hit = run.join(F.broadcast(plan), lang).where("__before >= __budget").groupBy(lang).agg(F.min(order).alias("c")).collect()
        new = dict.fromkeys(budgets, far) | {r[lang]: r["c"] for r in hit}
        if new == cut:
            return kept, rounds
        cut = new


def repair_splits(chunks: DataFrame, lang: str, split: str, order: list[str], share: int = 20) -> DataFrame:
    """Languages without val, then test chunks get their first max(1, n // share) remaining train chunks.

    A language with a single train chunk fills val only.  Two passes; each counts, then ranks only the
    languages that lack the split.  The first column of ``order`` is numeric.
    """
    for missing in ("val", "test"):
        n = chunks.groupBy(lang).agg(F.count(F.when(F.col(split) == "train", 1)).alias("__train"), F.max((F.col(split) == missing).cast("int")).alias("__has"))
        need = n.where("coalesce(__has, 0) = 0 AND __train > 0").select(F.col(lang).alias("__lang"), F.greatest(F.lit(1), F.floor(F.col("__train") / share)).alias("__quota"))
        marked = chunks.join(F.broadcast(need), F.col(lang).eqNullSafe(F.col("__lang")), "left").drop("__lang")
        lacking = marked.where(F.col("__quota").isNotNull() & (F.col(split) == "train")).withColumn("__one", F.lit(1))
        # places in the order, counted over cells of its first column: a language of any size is spread
        ranked = running_sum(order_key(lacking, order[0]), [lang], "__key", order, {"__r": "__one"})
        moved = ranked.withColumn(split, F.when(F.col("__r") < F.col("__quota"), missing).otherwise(F.col(split))).drop("__r", "__quota", "__one", "__key")
        rest = marked.where(F.col("__quota").isNull() | ~F.col(split).eqNullSafe(F.lit("train"))).drop("__quota")
        chunks = durable(rest.unionByName(moved), "repaired-splits")
    return chunks
