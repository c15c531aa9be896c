"""Queries that combine operators of the other modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrain.operators import curate as cu
from codegrain.plans.common import SQL_FILES, SQL_GOLD, file_values, files
from codegrain.plans.curation import SQL as CURATION_SQL
from codegrain.plans.curation import F05_denylist, aliases
from codegrain.plans.metrics import hits, weights
from codegrain.tables import table

S = SparkSession
BYTES = 40_000
CUT = 6_000


def J02_denylist_join(s: S, d: str) -> DataFrame:
    """Files of each split that the held-out texts leave."""
    return F05_denylist(s, d).groupBy("split").agg(F.count("*").alias("files"))


def J05_weighted_scores(s: S, d: str) -> DataFrame:
    """What each language adds to the weighted score; one without a score adds 0."""
    m = weights(s, d).join(hits(s, d), "lang", "left")
    return m.select("lang", F.round(F.col("weight") * F.coalesce(F.col("hit") / F.col("total"), F.lit(0.0)), 9).alias("part"))


def S11_budgeted_rows(s: S, d: str) -> DataFrame:
    """Rows within the size band, cut at a line end, until their language's budget of bytes is full."""
    cut = cu.truncate(F.col("text"), CUT, 200)
    one = file_values(s, d, "lang", "ord", cu.in_band(F.col("text")).alias("ok"), F.octet_length(cut).alias("n")).where("ok")
    one = one.withColumn("alias", F.lower("lang")).drop("lang").join(F.broadcast(aliases(s, d)), "alias")
    langs = [r[0] for r in table(s, d, "lang_dim").select("lang").collect()]  # fixed: 26 rows
    return cu.budget_cut(one, "lang", "ord", "n", dict.fromkeys(langs, BYTES)).select("lang", "file_id", "n")


def X02_stages(s: S, d: str) -> DataFrame:
    """The lexer's stages as tables: rows of the feature stage per kind."""
    from codegrain.operators.model import Lexer

    df = files(s, d).withColumn("uid", F.monotonically_increasing_id())
    rows = Lexer().features(df, "file_id", "text", "uid").groupBy("uid", "file_id", "kind").agg(F.count("*").alias("n"), F.sum("gap_prev").alias("g"))
    one = rows.groupBy("file_id", "kind").agg(F.max("n").alias("n"))
    return one.groupBy("kind").agg(F.sum("n").alias("n"))


def X01_tokenize_sql(s: S, d: str) -> DataFrame:
    """The table function over every file: tokens per kind."""
    from codegrain.functions.sql import register

    register(s)
    files(s, d).select("file_id", F.monotonically_increasing_id().alias("uid"), "text").createOrReplaceTempView("codegrain_files")
    # counted where a text is read; deliveries are merged on the counts
    each = "SELECT file_id, uid, kind, count(*) AS n, sum(length(token)) AS chars FROM codegrain_files, LATERAL tokenize(text) GROUP BY file_id, uid, kind"
    return s.sql(f"SELECT kind, sum(n) AS n, sum(chars) AS chars FROM (SELECT file_id, kind, max(n) AS n, max(chars) AS chars FROM ({each}) GROUP BY file_id, kind) GROUP BY kind")


_BAND = CURATION_SQL["F02_size_band"].split("SELECT lang, ", 1)[1].split(" AS ok", 1)[0]
_WEIGHTS = "w AS (SELECT lang, coalesce(pusher_share, 0.25) / sum(coalesce(pusher_share, 0.25)) OVER () AS weight FROM lang_dim)"
_AL = "al AS (SELECT alias, min(lang) AS lang FROM (SELECT lower(unnest(list_concat([lang], coalesce(aliases, [])))) AS alias, lang FROM lang_dim) GROUP BY alias)"
SQL = {
    "J02_denylist_join": f"SELECT split, count(*) AS files FROM ({CURATION_SQL['F05_denylist']}) GROUP BY split",
    "J05_weighted_scores": f"WITH {SQL_GOLD}, h AS (SELECT lang, count_if(gold = pred) / count(*) AS a FROM gold WHERE gold >= 0 GROUP BY lang), {_WEIGHTS} SELECT w.lang, round(weight * coalesce(a, 0), 9) AS part FROM w LEFT JOIN h ON w.lang = h.lang",
    "S11_budgeted_rows": f"""WITH {SQL_FILES}, {_AL}, o AS (SELECT file_id, f.ord, al.lang, text, length(regexp_extract(left(text, {CUT}), '(?s)^(.*)\\n', 1)) AS nl FROM f JOIN al ON lower(f.lang) = al.alias WHERE {_BAND}),
      n AS (SELECT file_id, ord, lang, strlen(CASE WHEN length(text) > {CUT} THEN left(text, CASE WHEN nl > 200 THEN nl ELSE {CUT} END) ELSE text END)::INT AS n FROM o),
      r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n) SELECT lang, file_id, n FROM r WHERE b < {BYTES} AND lang IN (SELECT lang FROM lang_dim)""",
    "X02_stages": f"WITH {SQL_GOLD} SELECT kind, count(*) AS n FROM gold WHERE kind IN (0, 3) GROUP BY kind",
    "X01_tokenize_sql": f"WITH {SQL_GOLD} SELECT kind, count(*) AS n, sum(len)::BIGINT AS chars FROM gold GROUP BY kind",
}
QUERIES = {k: v for k, v in globals().items() if k[:1] in "JSX" and k[1:3].isdigit()}
