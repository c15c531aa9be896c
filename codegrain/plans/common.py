"""Pieces shared by the query modules: one row per file, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrain.functions.featurize import feature_counts, token_rows
from codegrain.functions.lexing import NUMERIC, SCAN
from codegrain.tables import table


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files")


def one_per_file(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Light columns of ``files``, each file once (its deliveries have equal contents)."""
    return files(spark, d).groupBy("file_id").agg(*[F.max(c).alias(c) for c in cols])


def file_values(spark: SparkSession, d: str, *cols: Column) -> DataFrame:
    """Per-file values computed where the text is read, then each file once: texts are not shuffled."""
    df = files(spark, d).select("file_id", *cols)
    names = [c for c in df.columns if c != "file_id"]
    return df.groupBy("file_id").agg(*[F.max(c).alias(c) for c in names])


def tokens(spark: SparkSession, d: str, layout: str, fields: list[str], *carry: str, packed: bool = False) -> DataFrame:
    """Token rows with a delivery number ``uid``, for :func:`per_file`."""
    df = files(spark, d).withColumn("uid", F.monotonically_increasing_id())
    return token_rows(df, "file_id", "text", layout, fields, "uid", *carry, packed=packed)


def per_file(rows: DataFrame, keys: list[str], **sums: Column) -> DataFrame:
    """Sums per file and keys, each file counted once however often it was delivered.

    The first step folds a delivery's tokens in the task that read them.
    """
    each = rows.groupBy("uid", "file_id", *keys).agg(*[c.alias(n) for n, c in sums.items()])
    return each.groupBy("file_id", *keys).agg(*[F.max(n).alias(n) for n in sums])


def once(rows: DataFrame, keys: list[str], *values: str, id_col: str = "file_id") -> DataFrame:
    """Rows of texts delivered twice, once: their values are equal."""
    return rows.groupBy(id_col, *keys).agg(*[F.max(v).alias(v) for v in values])


def histogram(spark: SparkSession, d: str, layout: str, fields: list[str], *carry: str) -> DataFrame:
    """Number of tokens per combination of fields (and carried columns)."""
    keys = [*carry, *fields]
    rows = feature_counts(files(spark, d), "text", layout, fields, "file_id", *carry)
    whole = once(rows, keys, "n").groupBy(*keys).agg(F.sum("n").alias("n"))
    return whole.select(*carry, *[F.col(f).cast("int").alias(f) for f in fields], "n")


_W = r"0-9A-Za-z_\x{80}-\x{10FFFF}"
#: One row per file, as SQL.
SQL_FILES = "f AS (SELECT file_id, any_value(text) AS text, any_value(lang) AS lang, any_value(path) AS path, any_value(split) AS split, any_value(ord) AS ord FROM files GROUP BY file_id)"
#: Raw tokens, as SQL: positions, kind, buckets of the first and last character.
SQL_TOKENS = (
    SQL_FILES
    + rf""",
tok0 AS (SELECT file_id, lang, unnest(a) AS t, generate_subscripts(a, 1) - 1 AS ix FROM (SELECT file_id, lang, regexp_extract_all(text, '{SCAN}') AS a FROM f WHERE text IS NOT NULL)),
tok AS (SELECT file_id, lang, ix, t, length(t) AS len,
  CASE WHEN regexp_matches(t, '^[\r\n]') THEN 2 WHEN regexp_matches(t, '^[\t\x0B\x0C ]') THEN 1 WHEN regexp_matches(t, '^[{_W}]') THEN 0 ELSE 3 END AS kind,
  CASE WHEN unicode(t) > 127 THEN 95 ELSE unicode(t) END AS fc,
  CASE WHEN unicode(right(t, 1)) > 127 THEN 95 ELSE unicode(right(t, 1)) END AS lc
FROM tok0)"""
)
_TR = "//,/*,*/,--,=>,::,</,{{,${,}},->,??,?.,<>".split(",")
SQL_TRANS = "CASE " + " ".join(f"WHEN pl = {ord(p[0])} AND fc = {ord(p[1])} THEN {i + 1}" for i, p in enumerate(_TR)) + " ELSE 0 END"
SQL_SYM = "CASE WHEN pk = 3 OR kind = 3 THEN 1 + xor((pl + 1) * 131, fc) % 31 ELSE 0 END"
#: Kept tokens of the second feature version, as SQL.
SQL_KEPT = (
    SQL_TOKENS
    + r""",
lines AS (SELECT *, coalesce(sum((kind = 2)::INT) OVER (PARTITION BY file_id ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line,
  coalesce(sum(len) OVER (PARTITION BY file_id ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM tok),
lead AS (SELECT file_id, line, len + 3 * length(regexp_replace(t, '[^\t]', '', 'g')) AS width, contains(t, chr(9)) AS tab FROM (SELECT *, row_number() OVER (PARTITION BY file_id, line ORDER BY ix) AS rn FROM lines) WHERE rn = 1 AND kind = 1),
kept0 AS (SELECT l.*, coalesce(d.width, 0) AS width, coalesce(d.tab, false) AS tab,
  first_value(CASE WHEN kind = 0 THEN 0 ELSE instr('!"#$%&''()*+,-./:;<=>?@[\]^`{|}~', t) END) OVER (PARTITION BY l.file_id, l.line ORDER BY ix) AS line_first,
  row_number() OVER (PARTITION BY l.file_id, l.line ORDER BY ix) = 1 AS line_start,
  lag(l.line) OVER w AS pline, lag(ix) OVER w AS pix, lag(kind) OVER w AS pk, lag(lc) OVER w AS pl
FROM lines l LEFT JOIN lead d ON l.file_id = d.file_id AND l.line = d.line WHERE kind IN (0, 3) WINDOW w AS (PARTITION BY l.file_id ORDER BY ix)),
kept1 AS (SELECT *, CASE WHEN nl >= 2 THEN 3 WHEN nl = 1 THEN 2 WHEN sp THEN 1 ELSE 0 END AS gap_prev,
  CASE WHEN width <= 2 THEN width WHEN width <= 4 THEN 3 WHEN width <= 16 THEN 4 + (width - 5) // 4 ELSE 7 END AS indent,
  CASE WHEN t = '{' THEN 1 WHEN t = '}' THEN -1 ELSE 0 END AS db, CASE WHEN t IN ('(', '[') THEN 1 WHEN t IN (')', ']') THEN -1 ELSE 0 END AS dp
FROM (SELECT *, CASE WHEN pline IS NULL THEN line + 1 ELSE line - pline END AS nl, CASE WHEN pix IS NULL THEN ix > 0 ELSE ix > pix + 1 END AS sp FROM kept0)),
kept2 AS (SELECT *, coalesce(lead(gap_prev) OVER w, 2) AS gap_next, sum(db) OVER w AS sb, sum(dp) OVER w AS sp2,
  CASE WHEN gap_prev = 0 THEN """
    + SQL_TRANS
    + " ELSE 0 END AS trans_prev, "
    + SQL_SYM
    + r""" AS sym_prev FROM kept1 WINDOW w AS (PARTITION BY file_id ORDER BY ix)),
kept AS (SELECT *, sb - least(0, min(sb) OVER w) - (db > 0)::INT AS brace, sp2 - least(0, min(sp2) OVER w) - (dp > 0)::INT AS paren,
  coalesce(lead(trans_prev) OVER w, 0) AS trans_next, coalesce(lead(sym_prev) OVER w, 0) AS sym_next FROM kept2 WINDOW w AS (PARTITION BY file_id ORDER BY ix))"""
)
#: Raw tokens with their rule class (-1 for blanks), as SQL.
SQL_GOLD = (
    SQL_TOKENS
    + r""",
nx AS (SELECT *, lead(t) OVER w AS n1, lead(t, 2) OVER w AS n2, coalesce(sum(len) OVER (PARTITION BY file_id ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM tok WINDOW w AS (PARTITION BY file_id ORDER BY ix)),
gold AS (SELECT *, CASE WHEN gold < 0 THEN -1 WHEN kind = 3 THEN 8 ELSE 0 END AS pred FROM (SELECT *, CASE WHEN kind IN (1, 2) THEN -1 WHEN kind = 3 THEN 8 WHEN regexp_matches(t, '"""
    + NUMERIC
    + r"""') THEN 3 WHEN length(t) > 1 AND regexp_matches(t, '^[A-Z][A-Z0-9_]*$') THEN 7
  WHEN n1 = '(' OR (regexp_matches(n1, '^[ \t]+$') AND n2 = '(') THEN 6 ELSE 0 END AS gold FROM nx))""".replace("\\t", "\t")
)
