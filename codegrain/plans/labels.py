"""Queries of label algebra and alignment."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codegrain import dims
from codegrain.functions.labels import LETTERS, aligned_counts, aligned_rows, gold_rle, painted, piece_counts, rle_length, rle_runs, scored_rows, span_rows
from codegrain.plans.common import SQL_FILES, SQL_GOLD, file_values, files, once
from codegrain.tables import table

S = SparkSession

#: Scope stacks of the probes, outermost first.
PROBES = (
    "source.js|string.quoted.double.js", "source.js|comment.line.double-slash.js|punctuation.definition.comment.js", "source.py|constant.numeric.integer.py", "source.c|keyword.operator.assignment.c",
    "source.ts|storage.type.primitive.ts", "source.ts|storage.type.ts", "source.go|entity.name.function.go", "source.go|entity.name.type.struct.go", "source.rs|variable.other.constant.rs",
    "text.html.basic|entity.name.tag.html", "text.html.markdown|markup.heading.1.md|punctuation.definition.heading.md", "source.js|string.template.js|meta.template.expression.js|variable.other.readwrite.js",
    "source.js|string.template.js|punctuation.definition.template-expression.begin.js", "source.x|invalid.illegal.x", "source.x|unknown.thing", "something.else", "source.css|support.type.property-name.css",
    "source.py|meta.function-call.generic.py|support.function.builtin.py", "source.sql|keyword.other.select.sql", "source.rb|constant.other.symbol.rb", " Source.JS | COMMENT.Block.JS ",
)
STACKS = ("title.function", "string|subst", "keyword|operator", "meta|variable.constant", "comment|doctag", "params", "built_in", "literal", "punctuation", "template-string|number", "symbol")
TREES = ("keyword", "tag/attr-name", "unknown/string", "boolean", "foo/bar", "class-name/unknown", "function/unknown/number", "unknown")


#: What the last part of a probe is, to be replaced by a file's language.
_TAIL = r"\.(?:js|py|c|ts|go|rs|html|md|x|css|sql|rb|basic)(?=\s*(?:\||$))"


def _languages(s: S, d: str) -> DataFrame:
    """Languages of the files, as delivered, and their files; null is none."""
    return files(s, d).select("file_id", "lang").where("lang IS NOT NULL").groupBy("file_id").agg(F.max("lang").alias("lang")).groupBy("lang").agg(F.count("*").alias("files"))


def _probed(s: S, d: str, name: str, values: tuple[str, ...], by_lang: bool = True) -> DataFrame:
    """``id, lang, files`` and each probe, written for every language of the files."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("id"), F.lit(v).alias(name)) for i, v in enumerate(values)])).alias("p")
    rows = _languages(s, d).select("lang", "files", each).select("lang", "files", "p.*")
    return rows.withColumn(name, F.regexp_replace(name, F.lit(_TAIL), F.concat(F.lit("."), F.lower("lang")))) if by_lang else rows


def scope_class(scope: Column) -> Column:
    """Class number of the longest dotted prefix of a scope that the table has, null if none."""
    parts = F.split(scope, r"\.")
    rules = F.create_map(*[F.lit(x) for k, v in dims.SCOPES.items() for x in (k, dims.CLASS[v])])
    prefixes = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    return F.get(F.filter(F.transform(prefixes, lambda p: F.try_element_at(rules, p)), lambda c: c.isNotNull()), F.lit(0))


def scopes_class(stack: Column) -> Column:
    """Class of a scope stack, outermost first: the innermost scope with a class counts, else plain."""
    return F.coalesce(F.get(F.filter(F.transform(F.reverse(stack), scope_class), lambda c: c.isNotNull()), F.lit(0)), F.lit(0))


def normalized_scopes(stack: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(stack, lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def _inner(stack: Column) -> Column:
    """Without the outer template string where code is embedded."""
    embedded = F.exists(stack, lambda x: x.rlike(r"^meta\.(?:embedded|template\.expression)(?:\.|$)"))
    return F.when(embedded, F.filter(stack, lambda x: ~x.rlike(r"^string\.template(?:\.|$)"))).otherwise(stack)


def _hits(stack: Column, name: str, pattern: str) -> Column:
    if name == "keyword":
        return F.exists(stack, lambda x: x.rlike(pattern) & ~x.rlike(r"^keyword\.operator(?:\.|$)"))
    return F.exists(stack, lambda x: x.rlike(pattern))


def _matches(stack: Column, pattern: str) -> Column:
    return F.exists(stack, lambda x: x.rlike(pattern))


def other_class(stack: Column) -> Column:
    """Class name of a scope stack in the other taxonomy."""
    n = normalized_scopes(stack)
    out = F.when(F.exists(n, lambda x: x.rlike(r"^punctuation\.definition\.template-expression(?:\.|$)")), "operator")
    for name, pattern in dims.SCOPE_PATTERNS:
        out = out.when(_hits(_inner(n), name, pattern), name)
    return out.otherwise("plain")


def confidence(stack: Column) -> Column:
    """1 unambiguous, 0.5 several classes or unknown, 0.25 invalid."""
    n = _inner(normalized_scopes(stack))
    names = F.array_distinct(F.array_compact(F.array(*[F.when(_hits(n, name, p), name) for name, p in dims.SCOPE_PATTERNS])))
    odd = F.exists(n, lambda x: x.rlike(r"(?:^|\.)(?:unknown|unparsed|illegal)(?:\.|$)"))
    return F.when(F.exists(n, lambda x: x.rlike(r"^invalid(?:\.|$)")), 0.25).when(F.size(names) > 1, 0.5).when(odd, 0.5).otherwise(1.0)


def auxiliary(stack: Column) -> Column:
    n = _inner(normalized_scopes(stack))
    bits = F.lit(0)
    for i, pattern in enumerate(dims.AUXILIARY):
        bits = bits + F.when(_matches(n, pattern), 1 << i).otherwise(0)
    return bits


def L29_scope_class(s: S, d: str) -> DataFrame:
    one = _probed(s, d, "stack", PROBES).select("files", F.explode(F.split("stack", r"\|")).alias("scope"))
    return one.groupBy("scope").agg(F.sum("files").alias("files")).select("scope", "files", F.coalesce(scope_class(F.col("scope")), F.lit(-1)).alias("cls"))


def L30_scope_stack(s: S, d: str) -> DataFrame:
    return _probed(s, d, "stack", PROBES).select("id", "lang", scopes_class(F.split("stack", r"\|")).alias("cls"))


def L31_other_class(s: S, d: str) -> DataFrame:
    return _probed(s, d, "stack", PROBES).select("id", "lang", other_class(F.split("stack", r"\|")).alias("cls"))


def L32_confidence(s: S, d: str) -> DataFrame:
    return _probed(s, d, "stack", PROBES).select("id", "lang", confidence(F.split("stack", r"\|")).alias("confidence"))


def L33_auxiliary(s: S, d: str) -> DataFrame:
    return _probed(s, d, "stack", PROBES).select("id", "lang", auxiliary(F.split("stack", r"\|")).alias("bits"))


def stack_class(joined: Column) -> Column:
    out = None
    for needle, cls in dims.STACK_KINDS:
        hit = joined.contains(needle)
        out = F.when(hit, cls) if out is None else out.when(hit, cls)
    return out.otherwise(0)


def L34_stack_class(s: S, d: str) -> DataFrame:
    return _probed(s, d, "stack", STACKS, False).select("id", "lang", stack_class(F.regexp_replace("stack", r"\|", ".")).alias("cls"))


def L35_tree_class(s: S, d: str) -> DataFrame:
    """Types nest; one without a class inherits."""
    rules = F.create_map(*[F.lit(x) for kv in dims.TREE_TYPES.items() for x in kv])
    known = F.filter(F.transform(F.split("path", "/"), lambda t: F.try_element_at(rules, t)), lambda c: c.isNotNull())
    return _probed(s, d, "path", TREES, False).select("id", "lang", F.coalesce(F.try_element_at(known, F.lit(-1)), F.lit(-1)).alias("cls"))


def label_lines(s: S, d: str) -> DataFrame:
    """Label lines with a code, each once."""
    return table(s, d, "label_lines").where("rle IS NOT NULL AND rle <> ''").groupBy("line_no").agg(F.max("path").alias("path"), F.max("rle").alias("rle"), F.max("shard").alias("shard"))


def L36_rle_decode(s: S, d: str) -> DataFrame:
    runs = label_lines(s, d).select(F.explode(rle_runs(F.col("rle"))).alias("r")).select("r.*")
    return runs.groupBy("cls").agg(F.count("*").alias("n_runs"), F.sum("n").alias("n_chars"))


#: letters that stand for the classes 0 to 8 and masked places when label lines are written in the older code
AS_LETTERS = "ibsckpejgw"


def letter_spans(code: Column) -> Column:
    """Array of (start, end, type) of a letter code; whatever stands between the runs is ignored."""
    names = F.create_map(*[F.lit(x) for kv in LETTERS.items() for x in kv])
    part = lambda g: F.regexp_extract_all(code, F.lit("([" + "".join(LETTERS) + "])([0-9]+)"), F.lit(g))
    runs = F.zip_with(part(1), part(2), lambda a, n: F.struct(F.element_at(names, a).alias("type"), n.cast("long").alias("n")))
    grow = lambda acc, r: F.struct((acc["at"] + r["n"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    starts = F.aggregate(runs, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")), grow)["out"]
    return F.zip_with(starts, runs, lambda a, r: F.struct(a.alias("start"), (a + r["n"]).alias("end"), r["type"].alias("type")))


def L37_letter_decode(s: S, d: str) -> DataFrame:
    """Label lines written in the letter code and read back: spans, characters and starts by type."""
    letters = F.split(F.lit(AS_LETTERS), "")
    code = F.array_join(F.transform(rle_runs(F.col("rle")), lambda r: F.concat(F.get(letters, r["cls"]), r["n"].cast("string"))), "")
    spans_ = label_lines(s, d).select(F.explode(letter_spans(code)).alias("x")).select("x.*")
    return spans_.groupBy("type").agg(F.count("*").alias("spans"), F.sum(F.col("end") - F.col("start")).alias("chars"), F.sum("start").alias("starts"))


def L38_rle_encode(s: S, d: str) -> DataFrame:
    rows = gold_rle(files(s, d), "file_id", "text").select("file_id", F.length("rle").alias("n"), F.md5("rle").alias("digest"))
    return rows.groupBy("file_id").agg(F.max("n").alias("n"), F.max("digest").alias("digest"))


def _line_spans(s: S, d: str) -> DataFrame:
    """``line_no, chars, spans``: label runs as spans that reach one character into the next; short ones are in doubt.

    The text is three characters shorter than its runs, masked runs have a type that no class has.
    """
    names = F.create_map(*[F.lit(x) for k, v in dims.CLASS.items() for x in (v, k)])
    runs = rle_runs(F.col("rle"))
    grow = lambda acc, r: F.struct(
        (acc["at"] + r["n"]).alias("at"),
        F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + r["n"] + 1).alias("end"), F.coalesce(F.try_element_at(names, r["cls"]), F.lit("masked")).alias("type"), F.when(r["n"] == 1, 0.5).cast("double").alias("confidence")))).alias("out"),
    )
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,type:string,confidence:double>>").alias("out"))
    return label_lines(s, d).select("line_no", F.greatest(rle_length(F.col("rle")) - 3, F.lit(0)).alias("chars"), F.aggregate(runs, none, grow)["out"].alias("spans"))


def _painted(s: S, d: str, fill: int, gate: bool) -> DataFrame:
    return painted(_line_spans(s, d), "line_no", "chars", "spans", fill, gate).select("line_no", F.length("rle").alias("n"), F.md5("rle").alias("digest"))


def L39_gated_spans(s: S, d: str) -> DataFrame:
    return _painted(s, d, 9, True)


def L40_filled_spans(s: S, d: str) -> DataFrame:
    return _painted(s, d, 0, False)


def _paths(s: S, d: str) -> DataFrame:
    """File per path, each file once."""
    return files(s, d).where("path IS NOT NULL").groupBy("file_id").agg(F.max("path").alias("path"))


def L41_label_checks(s: S, d: str) -> DataFrame:
    """Labels whose run lengths cover their file exactly, stop short or overshoot."""
    size = file_values(s, d, "path", F.length("text").alias("chars")).where("path IS NOT NULL")
    lines = label_lines(s, d).select("line_no", "path", rle_length(F.col("rle")).alias("covered"))
    met = lines.join(size, "path")
    verdict = F.when(F.col("chars").isNull(), "no text").when(F.col("covered") == F.col("chars"), "exact").when(F.col("covered") < F.col("chars"), "short").otherwise("long")
    return met.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"), F.sum("covered").alias("covered"))


def scored(s: S, d: str, *carry: str) -> DataFrame:
    df = files(s, d).withColumn("uid", F.monotonically_increasing_id())
    return scored_rows(df, "file_id", "text", "uid", *carry)


def L42_spans(s: S, d: str) -> DataFrame:
    """Spans of equal class over scored tokens: how many begin, by class and language."""
    rows = span_rows(files(s, d), "text", "file_id", "lang").groupBy("file_id", "lang", "cls", "start").agg(F.max("end").alias("end"))
    return rows.groupBy("lang", F.col("cls").cast("int").alias("cls")).agg(F.count("*").alias("n_spans"), F.sum("start").alias("start_sum"))


def L43_pieces(s: S, d: str) -> DataFrame:
    """Spans and the gaps between them: together they are the text."""
    return once(piece_counts(files(s, d), "text", "file_id"), [], "n_spans", "n_gaps", "covered")


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def L44_html(s: S, d: str) -> DataFrame:
    """Escaped texts, a closing blank after a last line end."""
    html = escape_html(F.col("text"))
    html = F.when(F.col("text").endswith("\n"), F.concat(html, F.lit(" "))).otherwise(html)
    return file_values(s, d, F.md5(html).alias("digest"), F.length(html).alias("n"))


def L45_codecs(s: S, d: str) -> DataFrame:
    """Hex and base64 of vectors' labels as little-endian words, and back."""
    e = table(s, d, "embeddings").groupBy("vec_id").agg(F.max("label").alias("label"))
    word = F.concat(*[F.lpad(F.hex(F.shiftright(F.coalesce("label", F.lit(0)), 8 * i).bitwiseAND(255)), 2, "0") for i in range(4)])
    back = F.conv(F.concat(*[F.substring("word", 7 - 2 * i, 2) for i in range(4)]), 16, 10).cast("long")
    return e.select("vec_id", F.lower(word).alias("word")).select("vec_id", "word", F.base64(F.unhex("word")).alias("b64"), back.alias("back"))


def labelled_texts(s: S, d: str, *more: Column) -> DataFrame:
    """Files with their label lines: columns uid, file_id, line_no, lang, path, text, rle and ``more``."""
    lines = label_lines(s, d).where("path IS NOT NULL")
    df = files(s, d).select("file_id", "lang", "path", "text").join(lines.select("line_no", "path", "rle"), "path")
    return df.select("file_id", "line_no", "lang", "path", "text", "rle", *more).withColumn("uid", F.monotonically_increasing_id())


def labelled(s: S, d: str, layout: str, fields: list[str], *more: Column) -> DataFrame:
    """Tokens of files that have a label line, with labels: columns uid, line_no, file_id, lang, ``more``, tok_ix, label."""
    df = labelled_texts(s, d, *more)
    rest = [c for c in df.columns if c not in ("file_id", "text", "rle", "path")]
    return aligned_rows(df, "file_id", "text", "rle", layout, fields, *rest)


def J01_align(s: S, d: str) -> DataFrame:
    keys = ["line_no", "lang", "kind", "label"]
    rows = once(aligned_counts(labelled_texts(s, d), "text", "rle", "compact_v1", ["kind", "label"], "file_id", "line_no", "lang"), keys, "n")
    label = F.when(F.col("label") < 0, -100).otherwise(F.col("label")).cast("int")
    return rows.groupBy("lang", F.col("kind").cast("int").alias("kind"), label.alias("label")).agg(F.sum("n").alias("n"))


#: Fixed value: the digits of the older weight text.
B85 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz!#$%&()*+-;<=>?@^_`{|}~"


def base85_encode(word: Column) -> Column:
    """Five digits of an unsigned 32-bit word, the highest first."""
    return F.concat(*[F.substring(F.lit(B85), (F.floor(word / F.lit(85**i)) % 85 + 1).cast("int"), F.lit(1)) for i in (4, 3, 2, 1, 0)])


def base85_decode(text: Column) -> Column:
    return sum((F.instr(F.lit(B85), F.substring(text, 5 - i, 1)) - 1).cast("long") * F.lit(85**i) for i in (4, 3, 2, 1, 0))


def half_to_double(bits: Column) -> Column:
    """An IEEE half as a number."""
    sign = F.when(bits.bitwiseAND(0x8000) != 0, -1.0).otherwise(1.0)
    e, m = F.shiftright(bits, 10).bitwiseAND(31), bits.bitwiseAND(1023)
    special = F.when(m != 0, F.lit(float("nan"))).otherwise(sign * F.lit(float("inf")))
    return F.when(e == 0, sign * F.pow(F.lit(2.0), F.lit(-24)) * m).when(e == 31, special).otherwise(sign * F.pow(F.lit(2.0), e - 15) * (1 + m / 1024))


def L45_base85(s: S, d: str) -> DataFrame:
    """A word per vector as five digits, and back."""
    word = F.pmod(F.col("vec_id") * 2654435761, F.lit(1 << 32))
    e = table(s, d, "embeddings").where("vec_id IS NOT NULL").select("vec_id").distinct().withColumn("text", base85_encode(word))
    return e.select("vec_id", "text", base85_decode(F.col("text")).alias("back"))


def L45_half(s: S, d: str) -> DataFrame:
    """Halves of all sizes, one per vector; those that are no finite number are left out."""
    bits = F.pmod(F.col("vec_id") * 40503, F.lit(65536)).cast("int")
    e = table(s, d, "embeddings").where("vec_id IS NOT NULL").select("vec_id").distinct().withColumn("bits", bits)
    return e.where("shiftright(bits, 10) & 31 <> 31").select("vec_id", "bits", half_to_double(F.col("bits")).alias("value"))


def L47_close_names(s: S, d: str) -> DataFrame:
    """Unknown language names matched to known ones: exact after folding, else by similarity of 0.9 or more."""
    known = sorted(r[0] for r in table(s, d, "lang_dim").select("lang").where("lang IS NOT NULL").collect())  # fixed: 26 rows

    @F.pandas_udf("string")
    def close(names: pd.Series) -> pd.Series:
        return names.map(lambda n: (difflib.get_close_matches(n, known, 1, 0.9) or [None])[0] if n else None)

    names = files(s, d).where("lang IS NOT NULL").select(F.lower(F.regexp_replace("lang", "[ _]", "-")).alias("name")).distinct()
    return names.select("name", F.when(F.col("name").isin(known), F.col("name")).otherwise(close("name")).alias("lang"))


def _values(values: tuple[str, ...]) -> str:
    return ", ".join("(" + str(i) + ", '" + v.replace("'", "''") + "')" for i, v in enumerate(values))


_RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {dims.CLASS[v]})" for k, v in dims.SCOPES.items()) + ") AS t(prefix, cls))"
_LG = "lg AS (SELECT lang, count(*) AS files FROM (SELECT file_id, max(lang) AS lang FROM files GROUP BY file_id) WHERE lang IS NOT NULL GROUP BY lang)"
_PROBE = f"{_LG}, p AS (SELECT id, lang, files, array_to_string(list_transform(string_split(stack, '|'), lambda x: regexp_replace(x, '\\.(js|py|c|ts|go|rs|html|md|x|css|sql|rb|basic)( *)$', '.' || lower(lang) || '\\2')), '|') AS stack FROM (VALUES {_values(PROBES)}) AS t(id, stack), lg)"
_NORM = f"""{_PROBE}, n0 AS (SELECT DISTINCT id, lang, lower(trim(x)) AS scope FROM (SELECT id, lang, unnest(string_split(stack, '|')) AS x FROM p) WHERE trim(x) <> ''),
  e AS (SELECT id, lang, bool_or(regexp_matches(scope, '^meta\\.(embedded|template\\.expression)(\\.|$)')) AS emb FROM n0 GROUP BY id, lang),
  n AS (SELECT n0.* FROM n0 JOIN e USING (id, lang) WHERE NOT (emb AND regexp_matches(scope, '^string\\.template(\\.|$)')))"""


def _sql_hit(i: int) -> str:
    name, pattern = dims.SCOPE_PATTERNS[i]
    cond = f"regexp_matches(scope, '{pattern}')"
    return cond + (r" AND NOT regexp_matches(scope, '^keyword\.operator(?:\.|$)')" if name == "keyword" else "")


_RANKS = ", ".join(f"bool_or({_sql_hit(i)}) AS h{i}" for i in range(len(dims.SCOPE_PATTERNS)))
_LINES = "ll AS (SELECT line_no, max(path) AS path, max(rle) AS rle FROM label_lines WHERE rle IS NOT NULL AND rle <> '' GROUP BY line_no)"
_RUNS = (
    _LINES
    + ", r0 AS (SELECT line_no, path, unnest(regexp_extract_all(rle, '([0-9]):([0-9]+)', 1))::INT AS cls, unnest(regexp_extract_all(rle, '([0-9]):([0-9]+)', 2))::BIGINT AS n, generate_subscripts(regexp_extract_all(rle, '([0-9]):([0-9]+)'), 1) AS i FROM ll)"
)
SQL_LABELLED = f"{SQL_GOLD}, {_RUNS}, sp AS (SELECT line_no, path, cls, n, sum(n) OVER (PARTITION BY line_no ORDER BY i) - n AS s FROM r0 WHERE n > 0), ends AS (SELECT line_no, path, 9 AS cls, sum(n) AS s FROM sp GROUP BY ALL), sps AS (SELECT line_no, cls, s FROM sp UNION ALL SELECT line_no, cls, s FROM ends), jf AS (SELECT ll.line_no, f.file_id FROM ll JOIN f ON ll.path = f.path), jt AS (SELECT jf.line_no, g.* FROM gold g JOIN jf USING (file_id)), al AS (SELECT jt.*, CASE WHEN kind IN (1, 2) OR cls = 9 THEN NULL ELSE cls END AS label FROM jt ASOF LEFT JOIN sps ON jt.line_no = sps.line_no AND jt.start >= sps.s)"
_TREE = ", ".join(f"('{k}', {v})" for k, v in dims.TREE_TYPES.items())
_LSP = f"""{_RUNS}, ls AS (SELECT line_no, i, cls, n, (sum(n) OVER (PARTITION BY line_no ORDER BY i) - n)::BIGINT AS s, greatest((sum(n) OVER (PARTITION BY line_no)) - 3, 0)::BIGINT AS chars FROM r0)"""


def _sql_painted(gate: str, fill: int) -> str:
    return f"""WITH {_LSP}, ch AS (SELECT line_no, unnest(range(s, least(s + n + 1, chars))) AS ix, cls, i FROM ls WHERE cls < 9 AND {gate}), w AS (SELECT line_no, ix, arg_max(cls, i) AS cls FROM ch GROUP BY ALL),
      a AS (SELECT line_no, unnest(range(chars)) AS ix FROM (SELECT DISTINCT line_no, chars FROM ls)), b AS (SELECT a.line_no, a.ix, coalesce(cls, {fill}) AS cls FROM a LEFT JOIN w ON a.line_no = w.line_no AND a.ix = w.ix),
      c AS (SELECT *, lag(cls) OVER (PARTITION BY line_no ORDER BY ix) IS DISTINCT FROM cls AS new FROM b), g AS (SELECT *, sum(new::INT) OVER (PARTITION BY line_no ORDER BY ix) AS g FROM c), r AS (SELECT line_no, g, any_value(cls) || ':' || count(*) AS run FROM g GROUP BY ALL),
      t AS (SELECT line_no, string_agg(run, ',' ORDER BY g) AS rle FROM r GROUP BY line_no) SELECT ll.line_no, length(coalesce(t.rle, ''))::INT AS n, md5(coalesce(t.rle, '')) AS digest FROM ll LEFT JOIN t ON t.line_no = ll.line_no"""


_ISLANDS = "isl AS (SELECT *, sum((pg IS NULL OR pg <> gold)::INT) OVER (PARTITION BY file_id ORDER BY ix) AS island FROM (SELECT *, lag(gold) OVER (PARTITION BY file_id ORDER BY ix) AS pg FROM gold WHERE gold >= 0)), spn AS (SELECT file_id, lang, island, any_value(gold) AS cls, min(start) AS s, max(start + len) AS e FROM isl GROUP BY ALL)"
SQL = {
    "L29_scope_class": f"WITH {_RULES}, {_PROBE}, s AS (SELECT scope, sum(files)::BIGINT AS files FROM (SELECT files, unnest(string_split(stack, '|')) AS scope FROM p) GROUP BY scope) SELECT scope, files, coalesce(max_by(cls, length(prefix)), -1)::INT AS cls FROM s LEFT JOIN rules ON scope = prefix OR starts_with(scope, prefix || '.') GROUP BY scope, files",
    "L30_scope_stack": f"""WITH {_RULES}, {_PROBE}, s AS (SELECT id, lang, unnest(string_split(stack, '|')) AS scope, generate_subscripts(string_split(stack, '|'), 1) AS i FROM p),
      c AS (SELECT id, lang, i, max_by(cls, length(prefix)) AS cls FROM s LEFT JOIN rules ON scope = prefix OR starts_with(scope, prefix || '.') GROUP BY ALL) SELECT id, lang, coalesce(max_by(cls, i) FILTER (cls IS NOT NULL), 0)::INT AS cls FROM c GROUP BY id, lang""",
    "L31_other_class": f"""WITH {_NORM}, h AS (SELECT id, lang, {_RANKS} FROM n GROUP BY id, lang), te AS (SELECT id, lang, bool_or(regexp_matches(scope, '^punctuation\\.definition\\.template-expression(\\.|$)')) AS te FROM n0 GROUP BY id, lang)
      SELECT p.id, p.lang, CASE WHEN te THEN 'operator' {" ".join(f"WHEN h{i} THEN '{n}'" for i, (n, _) in enumerate(dims.SCOPE_PATTERNS))} ELSE 'plain' END AS cls FROM p LEFT JOIN h USING (id, lang) LEFT JOIN te USING (id, lang)""",
    "L32_confidence": f"""WITH {_NORM}, h AS (SELECT id, lang, {_RANKS}, bool_or(regexp_matches(scope, '^invalid(\\.|$)')) AS bad, bool_or(regexp_matches(scope, '(^|\\.)(unknown|unparsed|illegal)(\\.|$)')) AS odd FROM n GROUP BY id, lang),
      m AS (SELECT id, lang, bad, odd, len(list_distinct(list_filter([{", ".join(f"CASE WHEN h{i} THEN '{n}' END" for i, (n, _) in enumerate(dims.SCOPE_PATTERNS))}], lambda x: x IS NOT NULL))) AS k FROM h) SELECT id, lang, CASE WHEN bad THEN 0.25 WHEN k > 1 THEN 0.5 WHEN odd THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM m""",
    "L33_auxiliary": f"WITH {_NORM} SELECT id, lang, ({' + '.join(f'{1 << i} * bool_or(regexp_matches(scope, {chr(39)}{p}{chr(39)}))::INT' for i, p in enumerate(dims.AUXILIARY))})::INT AS bits FROM n GROUP BY id, lang",
    "L34_stack_class": f"WITH {_LG} SELECT id, lang, CASE {' '.join(f'WHEN contains(j, {chr(39)}{n}{chr(39)}) THEN {c}' for n, c in dims.STACK_KINDS)} ELSE 0 END AS cls FROM (SELECT id, lang, replace(stack, '|', '.') AS j FROM (VALUES {_values(STACKS)}) AS t(id, stack), lg)",
    "L35_tree_class": f"WITH {_LG}, r AS (SELECT * FROM (VALUES {_TREE}) AS t(type, cls)), p AS (SELECT id, lang, unnest(string_split(path, '/')) AS type, generate_subscripts(string_split(path, '/'), 1) AS i FROM (VALUES {_values(TREES)}) AS t(id, path), lg) SELECT id, lang, coalesce(max_by(cls, i) FILTER (cls IS NOT NULL), -1)::INT AS cls FROM p LEFT JOIN r USING (type) GROUP BY id, lang",
    "L36_rle_decode": f"WITH {_RUNS} SELECT cls, count(*) AS n_runs, sum(n)::BIGINT AS n_chars FROM r0 GROUP BY cls",
    "L37_letter_decode": f"WITH {_LSP}, m AS (SELECT * FROM (VALUES (0, 'identifier'), (1, 'break'), (2, 'string'), (3, 'class'), (4, 'keyword'), (5, 'property'), (6, 'entity'), (7, 'jsxliterals'), (8, 'sign'), (9, 'space')) AS t(cls, type)) SELECT type, count(*) AS spans, sum(n)::BIGINT AS chars, sum(s)::BIGINT AS starts FROM ls JOIN m USING (cls) GROUP BY type",
    "L38_rle_encode": f"""WITH {SQL_GOLD}, g AS (SELECT file_id, ix, len, CASE WHEN gold < 0 THEN 9 ELSE gold END AS c FROM gold), i AS (SELECT *, sum((p IS NULL OR p <> c)::INT) OVER (PARTITION BY file_id ORDER BY ix) AS isl FROM (SELECT *, lag(c) OVER (PARTITION BY file_id ORDER BY ix) AS p FROM g)),
      r AS (SELECT file_id, isl, any_value(c) || ':' || sum(len) AS run FROM i GROUP BY file_id, isl), x AS (SELECT file_id, string_agg(run, ',' ORDER BY isl) AS rle FROM r GROUP BY file_id), y AS (SELECT f.file_id, coalesce(rle, '') AS rle FROM f LEFT JOIN x USING (file_id) WHERE text IS NOT NULL) SELECT file_id, length(rle)::INT AS n, md5(rle) AS digest FROM y""",
    "L39_gated_spans": _sql_painted("n <> 1", 9),
    "L40_filled_spans": _sql_painted("true", 0),
    "L41_label_checks": f"WITH {SQL_FILES}, {_RUNS}, c AS (SELECT ll.line_no, ll.path, coalesce(sum(n), 0) AS covered FROM ll LEFT JOIN r0 ON ll.line_no = r0.line_no GROUP BY ALL) SELECT CASE WHEN text IS NULL THEN 'no text' WHEN covered = length(text) THEN 'exact' WHEN covered < length(text) THEN 'short' ELSE 'long' END AS verdict, count(*) AS n, sum(covered)::BIGINT AS covered FROM c JOIN f ON c.path = f.path GROUP BY ALL",
    "L42_spans": f"WITH {SQL_GOLD}, {_ISLANDS} SELECT lang, cls, count(*) AS n_spans, sum(s)::BIGINT AS start_sum FROM spn GROUP BY ALL",
    "L43_pieces": f"WITH {SQL_GOLD}, {_ISLANDS}, q AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY file_id ORDER BY s), 0) AS b FROM spn), z AS (SELECT file_id, count(*) AS n_spans, count_if(s > b) AS gaps, max(e) AS l, sum(e - s) AS covered FROM q GROUP BY file_id) SELECT f.file_id, coalesce(n_spans, 0) AS n_spans, (coalesce(gaps, 0) + (coalesce(length(text), 0) > coalesce(l, 0))::INT)::BIGINT AS n_gaps, coalesce(covered, 0)::BIGINT AS covered FROM f LEFT JOIN z USING (file_id)",
    "L44_html": f"WITH {SQL_FILES}, h AS (SELECT file_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') || CASE WHEN ends_with(text, chr(10)) THEN ' ' ELSE '' END AS html FROM f) SELECT file_id, md5(html) AS digest, length(html)::INT AS n FROM h",
    "L45_codecs": "WITH e AS (SELECT vec_id, coalesce(max(label), 0) AS label FROM embeddings GROUP BY vec_id), w AS (SELECT vec_id, label, lower(lpad(hex(label & 255), 2, '0') || lpad(hex((label >> 8) & 255), 2, '0') || lpad(hex((label >> 16) & 255), 2, '0') || lpad(hex((label >> 24) & 255), 2, '0')) AS word FROM e) SELECT vec_id, word, to_base64(unhex(word)) AS b64, label::BIGINT AS back FROM w",
    "L45_base85": f"""WITH e AS (SELECT DISTINCT vec_id, (vec_id * 2654435761) % 4294967296 AS w FROM embeddings WHERE vec_id IS NOT NULL) SELECT vec_id, {" || ".join(f"substr('{B85}', (w // {85**i} % 85 + 1)::INT, 1)" for i in (4, 3, 2, 1, 0))} AS text, w::BIGINT AS back FROM e""",
    "L45_half": "WITH e AS (SELECT DISTINCT vec_id, ((vec_id * 40503) % 65536)::INT AS bits FROM embeddings WHERE vec_id IS NOT NULL) SELECT vec_id, bits, CASE WHEN bits >= 32768 THEN -1 ELSE 1 END * CASE WHEN (bits >> 10) & 31 = 0 THEN pow(2::DOUBLE, -24) * (bits & 1023) ELSE pow(2::DOUBLE, ((bits >> 10) & 31) - 15) * (1 + (bits & 1023) / 1024) END AS value FROM e WHERE (bits >> 10) & 31 <> 31",
    "J01_align": f"WITH {SQL_LABELLED} SELECT lang, kind, coalesce(label, -100)::INT AS label, count(*) AS n FROM al GROUP BY ALL",
}
QUERIES = {k: v for k, v in globals().items() if k[:1] in "LJ" and k[1:3].isdigit()}
