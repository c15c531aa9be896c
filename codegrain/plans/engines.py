"""Queries of plug-ins, emitters and checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrain.functions.labels import gold_rle, scored_counts
from codegrain.operators import curate as cu
from codegrain.operators import engines as en
from codegrain.operators.model import Lexer
from codegrain.plans.common import SQL_FILES, SQL_GOLD, file_values, files
from codegrain.plans.curation import SHORT, SHORT_LEAST, P17_demo_pick
from codegrain.plans.metrics import JS_BLANK
from codegrain.tables import table

S = SparkSession


def S12_fixtures(s: S, d: str) -> DataFrame:
    """Files three folders below the root, under a language's folder, that are fit as fixtures, by language."""
    names = [r[0] for r in table(s, d, "lang_dim").select("lang").where("lang IS NOT NULL").collect()]  # fixed: 26 rows
    there = en.fixture_path(F.col("path"), 4, 3, tuple(names), not_endings=(".expect.txt",))
    one = file_values(s, d, "path", F.coalesce(en.fixture_text(F.col("text")), F.lit(False)).alias("fit")).where(F.coalesce(there, F.lit(False)))
    lang = F.get(F.split(F.regexp_replace("path", r"\\", "/"), "/"), F.lit(2))
    return one.groupBy(lang.alias("lang")).agg(F.sum(F.col("fit").cast("long")).alias("kept"), F.sum((~F.col("fit")).cast("long")).alias("dropped"), F.countDistinct(F.when(F.col("fit"), en.clean_name(F.col("path")))).alias("names"))


def K10_demo(s: S, d: str) -> DataFrame:
    """The demo files as they are written out: cut at a line end, as JSON."""
    cut = cu.truncate(F.col("text"), SHORT, SHORT_LEAST)
    text = files(s, d).select("file_id", F.struct("path", cut.alias("code")).alias("x")).join(P17_demo_pick(s, d), "file_id").groupBy("file_id", "lang", "rank").agg(F.max("x").alias("x"))
    return text.select("lang", "rank", "file_id", F.get_json_object(F.to_json(F.struct("lang", F.col("x.code").alias("code"))), "$.lang").alias("written_lang"), F.length("x.code").alias("chars"), F.md5("x.code").alias("digest"))


def K12_refcases(s: S, d: str) -> DataFrame:
    """Test cases as JSON lines, read back: the digest of the code and the run-length code of its classes."""
    rows = gold_rle(files(s, d).withColumn("code", F.col("text")), "file_id", "text", "code").select("file_id", "code", "rle")
    lines = en.reference_cases(rows, "file_id", F.col("file_id").cast("string"), F.col("code"), F.col("rle"))
    back = F.from_json("line", "name string, code string, classes string").alias("x")
    one = lines.select("file_id", back).select("file_id", F.md5("x.code").alias("code"), F.md5("x.classes").alias("classes"))
    return one.groupBy("file_id").agg(F.max("code").alias("code"), F.max("classes").alias("classes"))


def L46_resync(s: S, d: str) -> DataFrame:
    """Words found again in their texts, over whatever stands between: how many, and where."""
    parts = F.regexp_extract_all("text", F.lit(r"[^\t\n\f\r ]+"), F.lit(0))
    rows = en.resynced(files(s, d).where("text IS NOT NULL").withColumn("parts", parts), "file_id", "text", "parts")
    total = F.aggregate("starts", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("file_id", F.size("starts").alias("parts"), total.alias("starts")).groupBy("file_id").agg(F.max("parts").alias("parts"), F.max("starts").alias("starts"))


def J10_batched(s: S, d: str) -> DataFrame:
    """Texts whose classes are the same alone as in a batch."""
    rows = Lexer().alone(files(s, d), "file_id", "text").groupBy("file_id").agg(F.min("same").alias("same"))
    return rows.agg(F.count("*").alias("texts"), F.sum(F.col("same").cast("long")).alias("same"))


def _short(lang: Column) -> Column:
    return F.length(lang) <= 4


def X05_engines(s: S, d: str) -> DataFrame:
    """Two engines against the rule classes: by kind alone, and the rules themselves, which know short names only."""

    def by_kind(df: DataFrame) -> DataFrame:
        rows = scored_counts(df, "text", ["gold", "pred"], "file_id", "lang").withColumn("k", F.struct("gold", "pred"))
        once = rows.groupBy("file_id", "lang", "k").agg(F.max("chars").alias("chars"))
        return once.groupBy("file_id", "lang").agg(F.sum(F.when(F.col("k.gold") == F.col("k.pred"), F.col("chars")).otherwise(0)).alias("hit"), F.sum("chars").alias("total"))

    def by_rules(df: DataFrame) -> DataFrame:
        return by_kind(df).withColumn("hit", F.col("total"))

    engines = [en.Engine("kinds", lambda lang: F.lit(True), by_kind), en.Engine("rules", _short, by_rules)]
    return en.compare_engines(files(s, d), "file_id", "lang", F.length(F.regexp_replace("text", JS_BLANK, "")), engines)


_PIECE = re.compile(r"\n|[^\n\r]+")


def _lines(text: str, lang: str | None) -> list[tuple[str, int]] | None:
    """An engine that works line by line, cannot do tabs, and loses carriage returns."""
    return None if "\t" in text else [(p, 9 if p == "\n" else 0) for p in _PIECE.findall(text)]


def _whole(text: str, lang: str | None) -> list[tuple[str, int]]:
    return [(text, 0)] if text else []


def X06_labeller(s: S, d: str) -> DataFrame:
    """Labels by a plug-in with a fallback: how many texts each labelled and how many were dropped."""
    rows = en.label_texts(files(s, d), "file_id", "text", "lang", _lines, _whole).groupBy("file_id").agg(F.max("engine").alias("engine"), F.max("rle").alias("rle"))
    return rows.groupBy("engine", F.col("rle").isNull().alias("dropped")).agg(F.count("*").alias("texts"))


_PARTS = r"string_split(replace(path, '\', '/'), '/')"
SQL = {
    "S12_fixtures": rf"""WITH {SQL_FILES}, x AS (SELECT {_PARTS}[3] AS lang, path, coalesce(strlen(text) BETWEEN 1 AND 400000 AND NOT contains(text, chr(0)) AND regexp_matches(text, '[^\t\n\f\r\x0B ]'), false) AS fit FROM f WHERE len({_PARTS}) >= 4 AND {_PARTS}[3] IN (SELECT lang FROM lang_dim) AND NOT ends_with(path, '.expect.txt'))
      SELECT lang, count_if(fit)::BIGINT AS kept, count_if(NOT fit)::BIGINT AS dropped, count(DISTINCT regexp_replace(regexp_replace(path, '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g')) FILTER (fit) AS names FROM x GROUP BY lang""",
    "K10_demo": f"""WITH {SQL_FILES}, x AS (SELECT lang, file_id, text, row_number() OVER (PARTITION BY lang ORDER BY (length(text) BETWEEN {SHORT_LEAST} AND {SHORT}) DESC, md5('7:' || file_id), file_id)::INT AS rank FROM f WHERE lang IS NOT NULL AND length(text) > 0),
      y AS (SELECT *, length(regexp_extract(left(text, {SHORT}), '(?s)^(.*)\\n', 1)) AS nl FROM x WHERE rank <= 3), z AS (SELECT *, CASE WHEN length(text) > {SHORT} THEN left(text, CASE WHEN nl > {SHORT_LEAST} THEN nl ELSE {SHORT} END) ELSE text END AS t FROM y) SELECT lang, rank, file_id, lang AS written_lang, length(t)::INT AS chars, md5(t) AS digest FROM z""",
    "K12_refcases": f"""WITH {SQL_GOLD}, g AS (SELECT file_id, ix, len, CASE WHEN gold < 0 THEN 9 ELSE gold END AS c FROM gold), i AS (SELECT *, sum((p IS NULL OR p <> c)::INT) OVER (PARTITION BY file_id ORDER BY ix) AS isl FROM (SELECT *, lag(c) OVER (PARTITION BY file_id ORDER BY ix) AS p FROM g)),
      r AS (SELECT file_id, isl, any_value(c) || ':' || sum(len) AS run FROM i GROUP BY file_id, isl), x AS (SELECT file_id, string_agg(run, ',' ORDER BY isl) AS rle FROM r GROUP BY file_id) SELECT f.file_id, md5(text) AS code, md5(coalesce(rle, '')) AS classes FROM f LEFT JOIN x USING (file_id) WHERE text IS NOT NULL""",
    "L46_resync": rf"""WITH {SQL_FILES}, a AS (SELECT file_id, unnest(regexp_extract_all(text, '[^\t\n\f\r ]+|[\t\n\f\r ]+')) AS t, generate_subscripts(regexp_extract_all(text, '[^\t\n\f\r ]+|[\t\n\f\r ]+'), 1) AS i FROM f), b AS (SELECT *, sum(length(t)) OVER (PARTITION BY file_id ORDER BY i) - length(t) AS place FROM a),
      c AS (SELECT file_id, count(*) AS n, sum(place) AS s FROM b WHERE regexp_matches(t, '^[^\t\n\f\r ]') GROUP BY file_id) SELECT f.file_id, coalesce(n, 0)::INT AS parts, coalesce(s, 0)::BIGINT AS starts FROM f LEFT JOIN c USING (file_id) WHERE text IS NOT NULL""".replace("\\t", "\t").replace("\\f", "\f"),
    "J10_batched": f"WITH {SQL_FILES} SELECT count(*) AS texts, count(*) AS same FROM f",
    "X05_engines": f"""WITH {SQL_GOLD}, c AS (SELECT lang, coalesce(sum(len) FILTER (gold = pred), 0)::BIGINT AS hit, sum(len)::BIGINT AS total FROM gold WHERE gold >= 0 GROUP BY lang), v AS (SELECT lang, sum(length(regexp_replace(text, '{JS_BLANK}', '', 'g')))::BIGINT AS total FROM f GROUP BY lang)
      SELECT 'kinds' AS engine, lang, hit, total FROM c UNION ALL SELECT 'rules', lang, total, total FROM c WHERE length(lang) <= 4 UNION ALL SELECT 'rules', lang, 0, total FROM v WHERE lang IS NULL OR length(lang) > 4""",
    "X06_labeller": f"""WITH {SQL_FILES}, x AS (SELECT CASE WHEN text IS NULL THEN NULL WHEN contains(text, chr(9)) THEN 'fallback' ELSE 'first' END AS engine, text IS NULL OR (NOT contains(text, chr(9)) AND contains(text, chr(13))) AS dropped FROM f) SELECT engine, dropped, count(*) AS texts FROM x GROUP BY ALL""",
}
QUERIES = {k: v for k, v in globals().items() if k[:1] in "SKLJX" and k[1:3].isdigit()}
