"""Column functions of the lexer: the JVM-side forms of scanning, hashing and classifying."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One match per token: a fused or single line end, a run of blanks, a word, or one symbol.
SCAN = r"(?s)\r\n|\n|\r|[\t\x0B\x0C ]+|[0-9A-Za-z_\x{80}-\x{10FFFF}]+|."
WORD = r"[0-9A-Za-z_\x{80}-\x{10FFFF}]+"
#: Fixed value: numbers in the notations of common languages, with their suffixes.
NUMERIC = r"^[+-]?(0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|[0-9][0-9_]*(\.[0-9_]*)?([eE][+-]?[0-9]+)?)[uUlLfFdDnN]*(i8|i16|i32|i64|i128|isize|u8|u16|u32|u64|u128|usize|f32|f64)?$"
SCREAMING = r"^[A-Z][A-Z0-9_]*$"
#: The nine classes, by number.
CLASSES = ("plain", "comment", "string", "number", "keyword", "type", "function", "constant", "operator")
#: Words that count as constants, lower case.
BOOL_NULL = ("true", "false", "null", "nil", "none", "undefined", "nan", "inf", "nullptr", "void 0", "yes", "no", "on", "off", "null_t")
MASK32 = 4294967295


def scan(text: Column) -> Column:
    """All tokens of a text, in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(SCAN), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def kind(token: Column) -> Column:
    """0 word, 1 blanks, 2 line end, 3 symbol."""
    return F.when(token.rlike(r"^[\r\n]"), 2).when(token.rlike(r"^[\t\x0B\x0C ]"), 1).when(token.rlike("^" + WORD), 0).otherwise(3)


def char_bucket(c: Column) -> Column:
    return F.when(F.ascii(c) > 127, 95).otherwise(F.ascii(c))


def len_bucket(n: Column) -> Column:
    return F.when(n <= 1, 0).otherwise(F.least(F.lit(7), F.length(F.bin(n)) - 1))


def word_hash(word: Column, seed: int, mult: int) -> Column:
    """Finalised 32-bit hash; the product is split so that it never exceeds 63 bits."""

    def step(h: Column, c: Column) -> Column:
        x = h.bitwiseXOR(char_bucket(c).cast("long"))
        low = x.bitwiseAND(F.lit(65535)) * F.lit(mult)
        high = (F.shiftright(x, 16) * F.lit(mult)).bitwiseAND(F.lit(65535))
        return (low + F.shiftleft(high, 16)).bitwiseAND(F.lit(MASK32))

    return F.aggregate(F.split(word, ""), F.lit(seed).cast("long"), step, lambda h: h.bitwiseXOR(F.shiftright(h, 16)))


def symbol_hash(a: Column, b: Column) -> Column:
    return F.lit(1) + ((a + 1).cast("long") * 131).bitwiseAND(F.lit(MASK32)).bitwiseXOR(b.cast("long")) % 31


def is_numeric(text: Column) -> Column:
    return text.rlike(NUMERIC)


def is_screaming(text: Column) -> Column:
    return (F.length(text) > 1) & text.rlike(SCREAMING)


def project(token_type: Column, text: Column, applied: Column) -> Column:
    """Class number of a highlighter's token type, as trained on."""
    constant = F.lower(text).isin(*BOOL_NULL)
    named = F.when(applied, 6).when(constant, 7).when(is_numeric(text), 3).when(is_screaming(text), 7).otherwise(0)
    return (
        F.when(token_type == "comment", 1)
        .when(token_type.isin("string", "jsxliterals"), 2)
        .when(token_type == "sign", 8)
        .when(token_type == "entity", 6)
        .when(token_type == "keyword", F.when(constant, 7).otherwise(4))
        .when(token_type == "class", F.when(is_numeric(text), 3).when(is_screaming(text), 7).otherwise(5))
        .when(token_type.isin("identifier", "property"), named)
        .otherwise(0)
    )


def rule_class(token_kind: Column, text: Column, applied: Column) -> Column:
    """The rule class of a raw token (gold of the metric queries); null for blanks."""
    word = F.when(is_numeric(text), 3).when(is_screaming(text), 7).when(applied, 6).otherwise(0)
    return F.when(token_kind.isin(1, 2), F.lit(None).cast("int")).when(token_kind == 3, 8).otherwise(word)


def split_of(text: Column, val: int = 5, test: int = 5) -> Column:
    """Content split: the first 32 bits of the SHA-1 modulo 100."""
    bucket = F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket < test, "test").when(bucket < test + val, "val").when(bucket.isNotNull(), "train")
