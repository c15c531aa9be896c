"""Queries of the lexing and feature operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrain.functions import lexing as lx
from codegrain.functions.featurize import HASHES, features, group_sums, summed_rows, token_arrays
from codegrain.plans.common import SQL_FILES, SQL_KEPT, SQL_SYM, SQL_TOKENS, SQL_TRANS, file_values, files, histogram, once, per_file, tokens
from codegrain.schemas import LAYOUTS, N_FLAGS, WORD_HASHES

S = SparkSession


def L01_char_kinds(s: S, d: str) -> DataFrame:
    rows = tokens(s, d, "compact_v1", ["kind", "start", "end"])
    return per_file(rows, ["kind"], n=F.sum(F.col("end") - F.col("start"))).groupBy("kind").agg(F.sum("n").alias("n_chars"))


def L02_scan_counts(s: S, d: str) -> DataFrame:
    rows = histogram(s, d, "compact_v1", ["kind"], "lang").groupBy("lang")
    return rows.agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(n) for k, n in enumerate(("words", "blanks", "line_ends", "symbols"))])


def L03_first_chars(s: S, d: str) -> DataFrame:
    return histogram(s, d, "compact_v1", ["first_char", "last_char"])


def L04_len_bucket_hist(s: S, d: str) -> DataFrame:
    return histogram(s, d, "compact_v1", ["kind", "len_bucket"])


def L05_word_hash_checksum(s: S, d: str) -> DataFrame:
    rows = tokens(s, d, "large_v2", ["kind", "hash1", "hash2"], "lang").where("kind = 0")
    sums = per_file(rows, ["lang"], h1=F.sum("hash1"), h2=F.sum("hash2"), c1=F.sum(F.col("hash1") % 256), c2=F.sum(F.col("hash2") % 128), n=F.count("*"))
    return sums.groupBy("lang").agg(*[F.sum(c).alias(c) for c in ("h1", "h2", "c1", "c2", "n")])


def L05_word_hash_columns(s: S, d: str) -> DataFrame:
    """The same hashes as column expressions, once per distinct word."""
    df = files(s, d).select("file_id", F.explode(F.array_distinct(lx.words(F.col("text")))).alias("word")).select("word").distinct()
    h1, h2 = (lx.word_hash(F.col("word"), *x) for x in HASHES)
    one = df.select(h1.bitwiseAND(511).alias("h1"), h2.bitwiseAND(127).alias("h2"))
    return one.groupBy("h2").agg(F.count("*").alias("words"), F.sum("h1").alias("h1_sum"))


def L06_flag_hist(s: S, d: str) -> DataFrame:
    return histogram(s, d, "compact_v1", ["kind", "flags"])


def L07_transitions(s: S, d: str) -> DataFrame:
    a = histogram(s, d, "compact_v1", ["trans_prev"]).select(F.lit(1).alias("version"), "trans_prev", "n")
    b = histogram(s, d, "compact_v2", ["trans_prev"]).select(F.lit(2).alias("version"), "trans_prev", "n")
    return a.union(b)


def L08_symbol_pairs(s: S, d: str) -> DataFrame:
    a = histogram(s, d, "compact_v1", ["sym_prev"]).select(F.lit(1).alias("version"), "sym_prev", "n")
    b = histogram(s, d, "compact_v2", ["sym_prev"]).select(F.lit(2).alias("version"), "sym_prev", "n")
    return a.union(b)


def L09_gap_hist(s: S, d: str) -> DataFrame:
    return histogram(s, d, "compact_v2", ["kind", "gap_prev"])


def L10_indent_hist(s: S, d: str) -> DataFrame:
    return histogram(s, d, "compact_v2", ["indent"], "lang")


def L11_line_first(s: S, d: str) -> DataFrame:
    return histogram(s, d, "compact_v2", ["line_first"])


def L12_depth_profile(s: S, d: str) -> DataFrame:
    return histogram(s, d, "compact_v2", ["brace_depth", "paren_depth"])


def L13_gap_next(s: S, d: str) -> DataFrame:
    return histogram(s, d, "compact_v2", ["gap_prev", "gap_next"])


def L14_large_v1_structure(s: S, d: str) -> DataFrame:
    return histogram(s, d, "large_v1", ["paren_depth", "brace_depth", "bracket_depth", "indent_bucket"])


def L15_quote_states(s: S, d: str) -> DataFrame:
    return histogram(s, d, "large_v1", ["kind", "quote_state"])


def L16_large_v2_structure(s: S, d: str) -> DataFrame:
    return histogram(s, d, "large_v2", ["paren_depth", "brace_depth", "bracket_depth", "line_pos", "quote_state"])


def L17_token_arrays(s: S, d: str) -> DataFrame:
    """Column arrays per file, one per field of the layout; digests stand for them."""
    fields = [*LAYOUTS["compact_v2"].fields, "flags"]
    rows = token_arrays(files(s, d), "file_id", "text", "compact_v2", fields)
    digests = [F.md5(F.array_join(F.transform(f, lambda v: v.cast("string")), ",")).alias(f) for f in fields]
    return once(rows.select("file_id", "n", *digests).where("n > 0"), [], "n", *fields)


def L18_pack_xor(s: S, d: str) -> DataFrame:
    rows = tokens(s, d, "compact_v2", [], "lang", packed=True)
    one = per_file(rows, ["lang"], w0=F.bit_xor("w0"), w1=F.bit_xor("w1"), w2=F.bit_xor("w2"), s2=F.sum("w2"))
    return one.groupBy("lang").agg(F.bit_xor("w0").alias("w0"), F.bit_xor("w1").alias("w1"), F.bit_xor("w2").alias("w2"), F.sum("s2").alias("s2"))


def L19_pack_large(s: S, d: str) -> DataFrame:
    out = None
    for name in ("large_v1", "large_v2"):
        rows = tokens(s, d, name, [], packed=True)
        one = per_file(rows, [], w0=F.bit_xor("w0"), w1=F.bit_xor("w1"), w2=F.bit_xor("w2"))
        one = one.agg(F.bit_xor("w0").alias("w0"), F.bit_xor("w1").alias("w1"), F.bit_xor("w2").alias("w2")).select(F.lit(name).alias("layout"), "w0", "w1", "w2")
        out = one if out is None else out.union(one)
    return out


def L20_unpack(s: S, d: str) -> DataFrame:
    """Fields read back from packed words."""
    rows = tokens(s, d, "compact_v2", [], packed=True)
    back = rows.select("uid", "file_id", *[F.expr(e).cast("int").alias(n) for n, e in (("kind", "w0 & 3"), ("len_bucket", "shiftright(w0, 2) & 7"), ("gap_prev", "w2 & 3"), ("line_first", "shiftright(w2, 7) & 31"))])
    keys = ["kind", "len_bucket", "gap_prev", "line_first"]
    return per_file(back, keys, n=F.count("*")).groupBy(*keys).agg(F.sum("n").alias("n"))


def L22_embedding_rows(s: S, d: str) -> DataFrame:
    """How often each row of the embedding table is looked up: every field, hashes only for words, and eight flag rows."""
    lay = LAYOUTS["compact_v2"]

    def used(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        f = features(offsets, raw, "compact_v2")
        rows, ids = [], []
        for name, at in lay.offsets.items():
            if name == "flags":
                for bit in range(N_FLAGS):
                    hit = np.flatnonzero(f["flags"] >> bit & 1)
                    rows.append(f["row"][hit])
                    ids.append(np.full(len(hit), at + bit))
            else:
                hit = np.flatnonzero(f["kind"] == 0) if name in WORD_HASHES else np.arange(len(f["row"]))
                rows.append(f["row"][hit])
                ids.append(at + f[name][hit])
        row, keys, sums = group_sums(np.concatenate(rows), [np.concatenate(ids)], [])
        return row, [*keys, *sums]

    rows = once(summed_rows(files(s, d), "text", ["row_id", "n"], used, "file_id"), ["row_id"], "n")
    return rows.groupBy(F.col("row_id").cast("int").alias("row_id")).agg(F.sum("n").alias("n"))


ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def utf16_breaks(text: Column) -> Column:
    """Places (code points) of the characters that take two UTF-16 units."""
    before = F.split(text, ASTRAL)
    sizes = F.transform(F.slice(before, 1, F.size(before) - 1), F.length)
    return F.transform(sizes, lambda n, i: F.aggregate(F.slice(sizes, 1, i + 1), F.lit(0), lambda a, v: a + v) + i)


def utf16_point(unit: Column, breaks: Column) -> Column:
    """The code point that a UTF-16 offset stands at; the second unit of a character counts as behind it."""
    return unit - F.size(F.filter(F.transform(breaks, lambda p, i: p + i), lambda u: u < unit - 1))


def L23_utf16_offsets(s: S, d: str) -> DataFrame:
    """The map from UTF-16 offsets to code points, by the places where both drift apart; texts without one map to themselves."""
    breaks = F.when(F.col("text").rlike(ASTRAL), utf16_breaks(F.col("text")))
    one = file_values(s, d, F.length("text").alias("points"), breaks.alias("breaks"))
    rows = one.where("breaks IS NOT NULL").select("file_id", "points", "breaks", F.posexplode("breaks").alias("ix", "point_ix"))
    unit = F.col("point_ix") + F.col("ix")
    return rows.select("file_id", "points", "point_ix", unit.alias("unit_ix"), utf16_point(unit + 2, F.col("breaks")).alias("behind"))


def _distinct_words(s: S, d: str) -> DataFrame:
    """Number of files each word stands in."""
    df = files(s, d).select("file_id", F.explode(F.array_distinct(lx.words(F.col("text")))).alias("word"))
    return df.groupBy("file_id", "word").agg(F.lit(1).alias("n")).groupBy("word").agg(F.count("*").alias("n_files"))


def L24_numeric(s: S, d: str) -> DataFrame:
    return _distinct_words(s, d).groupBy(lx.is_numeric(F.col("word")).alias("numeric")).agg(F.count("*").alias("words"), F.sum("n_files").alias("n"))


def L25_screaming(s: S, d: str) -> DataFrame:
    return _distinct_words(s, d).where(lx.is_screaming(F.col("word"))).select("word", "n_files")


TYPES = ("comment", "string", "jsxliterals", "sign", "entity", "keyword", "class", "identifier", "property", "break", "space")


def L26_project(s: S, d: str) -> DataFrame:
    words = _distinct_words(s, d)
    each = words.select("word", F.explode(F.array(*[F.struct(F.lit(t).alias("type"), F.lit(a).alias("applied")) for t in TYPES for a in (True, False)])).alias("x")).select("word", "x.*")
    return each.groupBy("type", "applied", lx.project(F.col("type"), F.col("word"), F.col("applied")).alias("cls")).agg(F.count("*").alias("words"))


def L27_browser_types(s: S, d: str) -> DataFrame:
    """The browser's variant: keywords are never constants, identifiers never numbers."""
    w, t = F.col("word"), F.col("type")
    cls = (
        F.when(t == "comment", 1).when(t.isin("string", "jsxliterals"), 2).when(t == "sign", 8).when(t == "entity", 6).when(t == "keyword", 4)
        .when(t == "class", F.when(lx.is_numeric(w), 3).when(lx.is_screaming(w), 7).otherwise(5))
        .when(t.isin("identifier", "property"), F.when(F.col("applied"), 6).when(lx.is_screaming(w), 7).otherwise(0)).otherwise(0)
    )
    each = _distinct_words(s, d).select("word", F.explode(F.array(*[F.struct(F.lit(x).alias("type"), F.lit(a).alias("applied")) for x in TYPES for a in (True, False)])).alias("x")).select("word", "x.*")
    return each.groupBy("type", "applied", cls.alias("cls")).agg(F.count("*").alias("words"))


def L28_applied(s: S, d: str) -> DataFrame:
    """Words followed, past blanks, by an opening parenthesis."""
    calls = F.regexp_extract_all(F.col("text"), F.lit("(" + lx.WORD + r")[ \t]*\("), F.lit(1))
    return file_values(s, d, F.size(calls).alias("applied"), F.size(lx.words(F.col("text"))).alias("words")).where("words >= 0").agg(F.sum("applied").alias("applied"), F.sum("words").alias("words"))


_NUM, _SCR = lx.NUMERIC.replace("'", "''"), lx.SCREAMING
_NULLS = ", ".join(f"'{x}'" for x in lx.BOOL_NULL)
_WORDS = f"w AS (SELECT word, count(*) AS n_files FROM (SELECT DISTINCT file_id, unnest(regexp_extract_all(text, '{lx.WORD}')) AS word FROM f) GROUP BY word)"
_TYPES = "ty AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t in TYPES) + ") AS a(type), (VALUES (true), (false)) AS b(applied))"
_ISNUM, _ISSCR = f"regexp_matches(word, '{_NUM}')", f"(length(word) > 1 AND regexp_matches(word, '{_SCR}'))"
_FLAGS = """(CASE WHEN kind = 0 THEN (regexp_matches(t, '[a-z]'))::INT + 2 * (regexp_matches(t, '[A-Z]'))::INT + 4 * (regexp_matches(t, '[0-9]'))::INT + 8 * (regexp_matches(t, '[_\\x{80}-\\x{10FFFF}]'))::INT
   + 128 * (regexp_matches(t, '[A-Z]') AND NOT regexp_matches(t, '[a-z]'))::INT ELSE 0 END + CASE WHEN t = '\\' THEN 64 ELSE 0 END)"""
_LEN = "least(7, CASE WHEN len <= 1 THEN 0 ELSE floor(log2(len))::INT END)"
_V1 = ", v1 AS (SELECT *, lag(lc) OVER w AS pl, lag(kind) OVER w AS pk FROM tok WINDOW w AS (PARTITION BY file_id ORDER BY ix))"


def _hash(i: int) -> str:
    seed, mult = HASHES[i]
    step = f"list_reduce(list_prepend({seed}::UBIGINT, list_transform(string_split(word, ''), lambda c: (CASE WHEN unicode(c) > 127 THEN 95 ELSE unicode(c) END)::UBIGINT)), lambda h, c: ((xor(h, c) * {mult}::UBIGINT) & 4294967295::UBIGINT))"
    return f"(SELECT xor(q, q >> 16) FROM (SELECT {step} AS q))"


_U2 = f"u AS (SELECT word, {_hash(0)} AS a, {_hash(1)} AS b FROM (SELECT DISTINCT t AS word FROM kept WHERE kind = 0))"
_KFLAGS = f"({_FLAGS} + CASE WHEN line_start THEN 16 ELSE 0 END + CASE WHEN tab THEN 32 ELSE 0 END)"
#: fields of the compact layout as SQL over kept tokens, in embedding order, with their cardinalities
_KFIELDS = {
    "kind": "kind", "len_bucket": "len_bucket", "first_char": "fc", "last_char": "lc", "hash1": "hash1", "hash2": "hash2", "trans_prev": "trans_prev", "trans_next": "trans_next", "sym_prev": "symp",
    "sym_next": "sym_next", "gap_prev": "gap_prev", "gap_next": "gap_next", "indent": "indent", "line_first": "line_first", "brace_depth": "least(3, brace)", "paren_depth": "least(3, paren)", "flags": "flags",
}
_SIZES = (4, 8, 128, 128, 256, 128, 16, 16, 32, 32, 4, 4, 8, 32, 4, 4)
_ROWIDS = [f"{'CASE WHEN kind = 0 THEN ' if n.startswith('hash') else ''}{sum(_SIZES[:i])} + ({e})::BIGINT{' END' if n.startswith('hash') else ''}" for i, (n, e) in enumerate(list(_KFIELDS.items())[:16])]
_ROWIDS += [f"CASE WHEN (flags::BIGINT >> {bit}) & 1 = 1 THEN {sum(_SIZES) + bit}::BIGINT END" for bit in range(8)]
#: Quote state before each raw token, stepping over the quotes and backslashes of all files at once.
_QUOTE = r"""h0 AS (SELECT file_id, ix, kind, fc, sum((kind <> 1)::INT) OVER (PARTITION BY file_id ORDER BY ix) AS h FROM tok), sp AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ix) AS k FROM h0 WHERE kind = 3 AND fc IN (34, 39, 92, 96)),
 qs(file_id, k, ix, h, state, esc) AS (SELECT DISTINCT file_id, 0::BIGINT, -1::BIGINT, -5::HUGEINT, 0, false FROM sp UNION ALL SELECT s.file_id, s.k, s.ix, s.h,
   CASE WHEN s.fc = 92 OR (q.esc AND s.h = q.h + 1) THEN q.state WHEN q.state = CASE s.fc WHEN 39 THEN 1 WHEN 34 THEN 2 ELSE 3 END THEN 0 WHEN q.state = 0 THEN CASE s.fc WHEN 39 THEN 1 WHEN 34 THEN 2 ELSE 3 END ELSE q.state END,
   s.fc = 92 AND NOT (q.esc AND s.h = q.h + 1) FROM qs q JOIN sp s ON s.file_id = q.file_id AND s.k = q.k + 1),
 qt AS (SELECT l.*, coalesce(q.state, 0) AS quote FROM lines l ASOF LEFT JOIN qs q ON l.file_id = q.file_id AND l.ix > q.ix),
 dl AS (SELECT *, coalesce(sum((kind IN (0, 3))::INT) OVER (PARTITION BY file_id, line ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_pos, """ + ", ".join(
    f"sum(CASE WHEN kind = 3 AND quote = 0 THEN (fc = {o})::INT - (fc = {c})::INT ELSE 0 END) OVER (PARTITION BY file_id ORDER BY ix) AS s_{n}" for n, o, c in (("paren", 40, 41), ("brace", 123, 125), ("bracket", 91, 93))
) + " FROM qt), da AS (SELECT *, " + ", ".join(f"s_{n} - least(0, min(s_{n}) OVER (PARTITION BY file_id ORDER BY ix)) AS a_{n}" for n in ("paren", "brace", "bracket")) + " FROM dl), big AS (SELECT da.*, least(7, line_pos)::INT AS lp, " + ", ".join(
    f"least(7, coalesce(lag(a_{n}) OVER w, 0))::INT AS d_{n}" for n in ("paren", "brace", "bracket")
) + """, CASE WHEN kind = 1 AND line_pos = 0 THEN 0 ELSE coalesce(least(7, CASE WHEN coalesce(width, 0) = 0 THEN 0 ELSE length(ltrim(bin(width::BIGINT), '0')) END), 0) END::INT AS ib FROM da LEFT JOIN lead d ON da.file_id = d.file_id AND da.line = d.line WINDOW w AS (PARTITION BY da.file_id ORDER BY ix))"""
_W0 = lambda flags: f"(kind | ({_LEN} << 2) | (fc << 5) | (lc << 12))::BIGINT + ({flags}::BIGINT << 19) + (sym_next::BIGINT << 27)"
_W1 = "(coalesce(a, 0) & 1023)::BIGINT + ((coalesce(b, 0) & 255)::BIGINT << 10) + (trans_prev::BIGINT << 18) + (trans_next::BIGINT << 22) + ((symp)::BIGINT << 26)"
_RFLAGS = f"({_FLAGS} + CASE WHEN line_pos = 0 THEN 16 ELSE 0 END + CASE WHEN kind = 1 AND contains(t, chr(9)) THEN 32 ELSE 0 END)"
SQL = {
    "L14_large_v1_structure": f"WITH RECURSIVE {SQL_KEPT}, {_QUOTE} SELECT d_paren AS paren_depth, d_brace AS brace_depth, d_bracket AS bracket_depth, ib AS indent_bucket, count(*) AS n FROM big GROUP BY ALL",
    "L15_quote_states": f"WITH RECURSIVE {SQL_KEPT}, {_QUOTE} SELECT kind, quote AS quote_state, count(*) AS n FROM big GROUP BY ALL",
    "L16_large_v2_structure": f"WITH RECURSIVE {SQL_KEPT}, {_QUOTE} SELECT d_paren AS paren_depth, d_brace AS brace_depth, d_bracket AS bracket_depth, lp AS line_pos, quote AS quote_state, count(*) AS n FROM big WHERE kind IN (0, 3) GROUP BY ALL",
    "L19_pack_large": f"""WITH RECURSIVE {SQL_KEPT}, {_QUOTE}, u AS (SELECT word, {_hash(0)} AS a, {_hash(1)} AS b FROM (SELECT DISTINCT t AS word FROM tok WHERE kind = 0)),
      v0 AS (SELECT *, {SQL_TRANS} AS trans_prev, CASE WHEN pl IS NULL THEN 0 ELSE {SQL_SYM} END AS symp FROM (SELECT *, lag(lc) OVER w AS pl, lag(kind) OVER w AS pk FROM big WINDOW w AS (PARTITION BY file_id ORDER BY ix))),
      v1 AS (SELECT *, coalesce(lead(trans_prev) OVER w, 0) AS trans_next, coalesce(lead(symp) OVER w, 0) AS sym_next FROM v0 WINDOW w AS (PARTITION BY file_id ORDER BY ix)),
      p1 AS (SELECT {_W0(_RFLAGS)} AS w0, {_W1} AS w1, d_paren::BIGINT + (d_brace::BIGINT << 3) + (d_bracket::BIGINT << 6) + (lp::BIGINT << 9) + (ib::BIGINT << 12) + (quote::BIGINT << 15) AS w2 FROM v1 LEFT JOIN u ON t = word AND kind = 0),
      k2 AS (SELECT kept.*, CASE WHEN kept.pl IS NULL THEN 0 ELSE sym_prev END AS symp, d_paren, d_brace, d_bracket, lp, quote FROM kept JOIN big USING (file_id, ix)),
      p2 AS (SELECT {_W0(_KFLAGS)} AS w0, {_W1} AS w1, gap_prev::BIGINT + (gap_next::BIGINT << 2) + (indent::BIGINT << 4) + (line_first::BIGINT << 7) + (d_brace::BIGINT << 12) + (d_paren::BIGINT << 15) + (d_bracket::BIGINT << 18) + (lp::BIGINT << 21) + (quote::BIGINT << 24) AS w2 FROM k2 LEFT JOIN u ON t = word AND kind = 0)
      SELECT 'large_v1' AS layout, bit_xor(w0) AS w0, bit_xor(w1) AS w1, bit_xor(w2) AS w2 FROM p1 UNION ALL SELECT 'large_v2', bit_xor(w0), bit_xor(w1), bit_xor(w2) FROM p2""",
    "L01_char_kinds": f"WITH {SQL_TOKENS} SELECT kind, sum(len)::BIGINT AS n_chars FROM tok GROUP BY kind",
    "L02_scan_counts": f"WITH {SQL_TOKENS} SELECT lang, count_if(kind = 0)::BIGINT AS words, count_if(kind = 1)::BIGINT AS blanks, count_if(kind = 2)::BIGINT AS line_ends, count_if(kind = 3)::BIGINT AS symbols FROM tok GROUP BY lang",
    "L03_first_chars": f"WITH {SQL_TOKENS} SELECT fc AS first_char, lc AS last_char, count(*) AS n FROM tok GROUP BY ALL",
    "L04_len_bucket_hist": f"WITH {SQL_TOKENS} SELECT kind, {_LEN} AS len_bucket, count(*) AS n FROM tok GROUP BY ALL",
    "L05_word_hash_checksum": f"""WITH {SQL_TOKENS}, d AS (SELECT lang, t AS word, count(*) AS n FROM tok WHERE kind = 0 GROUP BY ALL), u AS (SELECT word, {_hash(0)} AS a, {_hash(1)} AS b FROM (SELECT DISTINCT word FROM d))
      SELECT lang, sum(n * (a & 1023))::BIGINT AS h1, sum(n * (b & 255))::BIGINT AS h2, sum(n * (a & 255))::BIGINT AS c1, sum(n * (b & 127))::BIGINT AS c2, sum(n)::BIGINT AS n FROM d JOIN u USING (word) GROUP BY lang""",
    "L05_word_hash_columns": f"WITH {SQL_FILES}, {_WORDS}, u AS (SELECT {_hash(0)} & 511 AS h1, {_hash(1)} & 127 AS h2 FROM w) SELECT h2::BIGINT AS h2, count(*) AS words, sum(h1)::BIGINT AS h1_sum FROM u GROUP BY h2",
    "L06_flag_hist": f"""WITH {SQL_TOKENS}, l AS (SELECT *, coalesce(sum((kind = 2)::INT) OVER (PARTITION BY file_id ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM tok),
      m AS (SELECT *, coalesce(sum((kind IN (0, 3))::INT) OVER (PARTITION BY file_id, line ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS ls FROM l)
      SELECT kind, ({_FLAGS} + CASE WHEN ls THEN 16 ELSE 0 END + CASE WHEN kind = 1 AND contains(t, chr(9)) THEN 32 ELSE 0 END)::INT AS flags, count(*) AS n FROM m GROUP BY ALL""",
    "L07_transitions": f"WITH {SQL_KEPT}{_V1} SELECT 1 AS version, {SQL_TRANS} AS trans_prev, count(*) AS n FROM v1 GROUP BY ALL UNION ALL SELECT 2, trans_prev, count(*) FROM kept GROUP BY ALL",
    "L08_symbol_pairs": f"WITH {SQL_KEPT}{_V1} SELECT 1 AS version, CASE WHEN pl IS NULL THEN 0 ELSE {SQL_SYM} END AS sym_prev, count(*) AS n FROM v1 GROUP BY ALL UNION ALL SELECT 2, CASE WHEN pl IS NULL THEN 0 ELSE sym_prev END, count(*) FROM kept GROUP BY ALL",
    "L09_gap_hist": f"WITH {SQL_KEPT} SELECT kind, gap_prev, count(*) AS n FROM kept GROUP BY ALL",
    "L10_indent_hist": f"WITH {SQL_KEPT} SELECT lang, indent::INT AS indent, count(*) AS n FROM kept GROUP BY ALL",
    "L11_line_first": f"WITH {SQL_KEPT} SELECT line_first::INT AS line_first, count(*) AS n FROM kept GROUP BY ALL",
    "L12_depth_profile": f"WITH {SQL_KEPT} SELECT least(3, brace)::INT AS brace_depth, least(3, paren)::INT AS paren_depth, count(*) AS n FROM kept GROUP BY ALL",
    "L13_gap_next": f"WITH {SQL_KEPT} SELECT gap_prev, gap_next, count(*) AS n FROM kept GROUP BY ALL",
    "L17_token_arrays": f"""WITH {SQL_KEPT}, {_U2}, z AS (SELECT kept.*, {_LEN} AS len_bucket, coalesce(a, 0) & 255 AS hash1, coalesce(b, 0) & 127 AS hash2, {_KFLAGS} AS flags, CASE WHEN pl IS NULL THEN 0 ELSE sym_prev END AS symp FROM kept LEFT JOIN u ON t = word AND kind = 0)
      SELECT file_id, count(*)::INT AS n, {", ".join(f"md5(string_agg(({e})::VARCHAR, ',' ORDER BY ix)) AS {n}" for n, e in _KFIELDS.items())} FROM z GROUP BY file_id""",
    "L18_pack_xor": f"""WITH {SQL_KEPT}, u AS (SELECT word, {_hash(0)} AS a, {_hash(1)} AS b FROM (SELECT DISTINCT t AS word FROM kept WHERE kind = 0)),
      p AS (SELECT lang, (kind | ({_LEN} << 2) | (fc << 5) | (lc << 12))::BIGINT + (({_FLAGS} + CASE WHEN line_start THEN 16 ELSE 0 END + CASE WHEN tab THEN 32 ELSE 0 END)::BIGINT << 19) + (sym_next::BIGINT << 27) AS w0,
        (coalesce(a, 0) & 255)::BIGINT + ((coalesce(b, 0) & 127)::BIGINT << 10) + (trans_prev::BIGINT << 17) + (trans_next::BIGINT << 21) + ((CASE WHEN pl IS NULL THEN 0 ELSE sym_prev END)::BIGINT << 25) AS w1,
        gap_prev::BIGINT + (gap_next::BIGINT << 2) + (indent::BIGINT << 4) + (line_first::BIGINT << 7) + (least(3, brace)::BIGINT << 12) + (least(3, paren)::BIGINT << 14) AS w2 FROM kept LEFT JOIN u ON t = word AND kind = 0)
      SELECT lang, bit_xor(w0) AS w0, bit_xor(w1) AS w1, bit_xor(w2) AS w2, sum(w2)::BIGINT AS s2 FROM p GROUP BY lang""",
    "L20_unpack": f"WITH {SQL_KEPT} SELECT kind, {_LEN} AS len_bucket, gap_prev, line_first::INT AS line_first, count(*) AS n FROM kept GROUP BY ALL",
    "L22_embedding_rows": f"""WITH {SQL_KEPT}, {_U2}, z AS (SELECT kept.*, {_LEN} AS len_bucket, coalesce(a, 0) & 255 AS hash1, coalesce(b, 0) & 127 AS hash2, {_KFLAGS} AS flags, CASE WHEN pl IS NULL THEN 0 ELSE sym_prev END AS symp FROM kept LEFT JOIN u ON t = word AND kind = 0),
      r AS (SELECT unnest([{", ".join(_ROWIDS)}]) AS row_id FROM z) SELECT row_id::INT AS row_id, count(*) AS n FROM r WHERE row_id IS NOT NULL GROUP BY ALL""",
    "L23_utf16_offsets": f"""WITH {SQL_FILES}, c AS (SELECT file_id, length(text) AS points, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS p FROM f WHERE regexp_matches(text, '[\\x{{10000}}-\\x{{10FFFF}}]')), w AS (SELECT *, sum((unicode(ch) > 65535)::INT) OVER (PARTITION BY file_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)
      SELECT file_id, points::INT AS points, p::INT AS point_ix, (p + coalesce(before, 0))::INT AS unit_ix, (p + 1)::INT AS behind FROM w WHERE unicode(ch) > 65535""",
    "L24_numeric": f"WITH {SQL_FILES}, {_WORDS} SELECT {_ISNUM} AS numeric, count(*) AS words, sum(n_files)::BIGINT AS n FROM w GROUP BY ALL",
    "L25_screaming": f"WITH {SQL_FILES}, {_WORDS} SELECT word, n_files FROM w WHERE {_ISSCR}",
    "L26_project": f"""WITH {SQL_FILES}, {_WORDS}, {_TYPES} SELECT type, applied, CASE WHEN type = 'comment' THEN 1 WHEN type IN ('string', 'jsxliterals') THEN 2 WHEN type = 'sign' THEN 8 WHEN type = 'entity' THEN 6
      WHEN type = 'keyword' THEN CASE WHEN lower(word) IN ({_NULLS}) THEN 7 ELSE 4 END WHEN type = 'class' THEN CASE WHEN {_ISNUM} THEN 3 WHEN {_ISSCR} THEN 7 ELSE 5 END
      WHEN type IN ('identifier', 'property') THEN CASE WHEN applied THEN 6 WHEN lower(word) IN ({_NULLS}) THEN 7 WHEN {_ISNUM} THEN 3 WHEN {_ISSCR} THEN 7 ELSE 0 END ELSE 0 END AS cls, count(*) AS words FROM w, ty GROUP BY ALL""",
    "L27_browser_types": f"""WITH {SQL_FILES}, {_WORDS}, {_TYPES} SELECT type, applied, CASE WHEN type = 'comment' THEN 1 WHEN type IN ('string', 'jsxliterals') THEN 2 WHEN type = 'sign' THEN 8 WHEN type = 'entity' THEN 6
      WHEN type = 'keyword' THEN 4 WHEN type = 'class' THEN CASE WHEN {_ISNUM} THEN 3 WHEN {_ISSCR} THEN 7 ELSE 5 END
      WHEN type IN ('identifier', 'property') THEN CASE WHEN applied THEN 6 WHEN {_ISSCR} THEN 7 ELSE 0 END ELSE 0 END AS cls, count(*) AS words FROM w, ty GROUP BY ALL""",
    "L28_applied": f"WITH {SQL_FILES} SELECT sum(len(regexp_extract_all(text, '({lx.WORD})[ \\t]*\\(', 1)))::BIGINT AS applied, sum(len(regexp_extract_all(text, '{lx.WORD}')))::BIGINT AS words FROM f WHERE text IS NOT NULL",
}

QUERIES = {k: v for k, v in globals().items() if k[:1] == "L" and k[1:3].isdigit()}
