"""Problem 8: one consistent form for texts that look the same.

Steps on a text: compatibility decomposition; invisible characters dropped; blanks other than tab and line
ends made plain; hyphens drawn like ``-`` made ``-``; letters drawn like a Latin letter resolved; accents
composed with their letters.

Letters are resolved token by token (a token being a run of letters and marks).  Every letter has a resolved
script set: the scripts that have a letter drawn like it, its own among them; marks belong to all.  The sets are
intersected over the token.  If Latin remains, the token is whole-script confusable (letters of one other
script only) or mixed with Latin, and Latin is its spelling.  If another script remains, a letter without a
Latin look-alike holds the token there, and letters from elsewhere take that script's spelling.  If none
remains, look-alikes become Latin.  A letter's set and the spelling depend on what it is drawn like only, so
tokens drawn alike get one form.

Letters of ``SIMILAR`` are drawn like a Latin one in many fonts, but apart from others of their script that are
too (a sigma from an omicron); they become Latin where Latin remains and stay in words of their own script.
Latin letters with a place in some alphabet (a dotless i) are letters of their own, as accents are.

Defined results: null stays null, an empty text stays empty; a text with nothing visible has a form but is
no case for comparison; ids count once (the latest delivered).
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrain.operators.durable import durable
from codegrain.operators.ordered import salted_join, self_pairs

# Letters that Unicode's confusables draw like a Latin letter, by script.
LOOKALIKES: dict[str, dict[str, str]] = {
    "Cyrillic": dict(zip("АВЕЅІЈКМНОРСТУХҮԚԜѴаеоѕіјрсухһԁԛԝӏүѵ", "ABESIJKMHOPCTYXYQWVaeosijpcyxhdqwlyv", strict=True)),
    "Greek": dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϹϲϳ", "ABEZHIKMNOPTYXovCcj", strict=True)),
    "Armenian": dict(zip("օսհցզոՕՍԼ", "ouhgqnOUL", strict=True)),
    "Cherokee": dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᎽᏃ", "ABCDEGHJKLMPRSTVWYZ", strict=True)),
    "Coptic": dict(zip("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "HIKMNOPCTYXopc", strict=True)),
    "Lisu": dict(zip("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ", strict=True)),
}
#: Letters drawn like a Latin one in many fonts, but not like each other within their script.
SIMILAR: dict[str, dict[str, str]] = {"Greek": dict(zip("αγιρσυϱ", "ayipoup", strict=True)), "Cherokee": dict(zip("ᏒᏔ", "RW", strict=True))}
#: Fixed value: a Latin letter that is another one in a different drawing.
SAME_LETTER = {"ɡ": "g"}
#: Hyphens drawn like the ASCII one.
HYPHENS = "\u2010\u2011\u2012\u2043\u02d7\u2212\ufe63\uff0d"
#: Invisible characters outside the general category Cf.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"

_ALIKE = {c: to for letters in LOOKALIKES.values() for c, to in letters.items()}
_SIMILAR = {c: to for letters in SIMILAR.values() for c, to in letters.items()}
_TO_LATIN = {ord(c): to for c, to in (_ALIKE | _SIMILAR).items()}
#: look-alikes that a compatibility decomposition would turn into another letter
_BEFORE = {ord(c): to for c, to in (_ALIKE | SAME_LETTER).items() if unicodedata.normalize("NFKD", c) != c or c in SAME_LETTER}


def _back(letters: dict[str, str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for c, to in letters.items():
        if ord(c) not in _BEFORE:
            out.setdefault(to, c)
    return out


_FROM_LATIN = {script: _back(letters) for script, letters in LOOKALIKES.items()}
LATIN = 1
_BIT = {script: 2 << i for i, script in enumerate(LOOKALIKES)}
_OTHER = 2 << len(LOOKALIKES)  # all further scripts: none of them has a look-alike here
_ALL = 2 * _OTHER - 1
_DRAWN = {to: LATIN for to in map(chr, (*range(65, 91), *range(97, 123)))}  # Latin letter -> scripts that have it
for _script, _letters in _FROM_LATIN.items():
    for _to in _letters:
        _DRAWN[_to] |= _BIT[_script]
_TOKEN = regex.compile(r"[\p{L}\p{M}]+")
_FOREIGN = regex.compile("|".join(rf"\p{{{s}}}" for s in LOOKALIKES))
_SCRIPTS = {s: regex.compile(rf"\p{{{s}}}") for s in LOOKALIKES}
_LATIN = regex.compile(r"\p{Latin}")
_LETTER = regex.compile(r"\p{L}")


class _Sets(dict):
    """``(own script, resolved script set)`` of a character, as bits."""

    def __missing__(self, c: str) -> tuple[int, int]:
        if not _LETTER.match(c):
            out = (0, _ALL)
        else:
            own = LATIN if _LATIN.match(c) else next((_BIT[s] for s, has in _SCRIPTS.items() if has.match(c)), _OTHER)
            out = (own, own | _DRAWN.get(_ALIKE.get(c) or _SIMILAR.get(c) or c, 0))
        self[c] = out
        return out


_SETS = _Sets()
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_VISIBLE = regex.compile(r"[^\s\p{C}\p{Z}]")


def _plain(c: str) -> str | None:
    """What a character becomes before letters are resolved; None drops it."""
    if c in "\t\n\r":
        return c
    if c in HYPHENS:
        return "-"
    kind = unicodedata.category(c)
    if kind == "Cf" or c in INVISIBLE or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0000 <= ord(c) <= 0xE0FFF:
        return None
    if kind == "Cc":
        return c if c == "\x85" else " " if c in "\x0b\x0c" else None
    return " " if kind == "Zs" else c


class _Table(dict):
    def __missing__(self, code: int) -> str | None:
        self[code] = to = _plain(chr(code))
        return to


_PLAIN = _Table()


@lru_cache(maxsize=1 << 16)
def resolve(token: str) -> tuple[str, str]:
    """The consistent spelling of a decomposed token, and ``mixed``, ``whole`` (confusable) or nothing."""
    used, common = 0, _ALL
    for c in token:
        own, scripts = _SETS[c]
        used |= own
        common &= scripts
    verdict = "mixed" if used & (used - 1) else ""
    if common & LATIN:
        return token.translate(_TO_LATIN), verdict or ("whole" if used != LATIN else "")
    script = next((s for s, bit in _BIT.items() if common & bit), None)
    if script is None:
        # scripts that share nothing
        return token.translate(_TO_LATIN), verdict
    back, bit = _FROM_LATIN[script], _BIT[script]
    out = []
    for c in token:
        to = _ALIKE.get(c) or (c if _SETS[c][0] != bit and c not in _SIMILAR else "" if _SETS[c][0] == bit else _SIMILAR[c])
        out.append(back.get(to, c) if to else c)
    return "".join(out), verdict


def normalize(text: str, tally: dict[str, int] | None = None) -> str:
    """The consistent form of a text; ``tally`` counts its mixed and whole-script confusable tokens."""
    if text.isascii() and not _CONTROL.search(text):
        return text

    def spelled(m: regex.Match) -> str:
        token = m.group()
        if token.isascii():
            return token
        token, verdict = resolve(token)
        if verdict and tally is not None:
            tally[verdict] = tally.get(verdict, 0) + 1
        return token

    plain = unicodedata.normalize("NFKD", text.translate(_BEFORE)).translate(_PLAIN)
    if not plain.isascii() and _FOREIGN.search(plain):
        plain = _TOKEN.sub(spelled, plain)
    return unicodedata.normalize("NFC", plain)


def visible(text: str) -> bool:
    return bool(_VISIBLE.search(text))


def normalized(df: DataFrame, id_col: str, text_col: str, version_col: str | None = None, keep_text: bool = True) -> DataFrame:
    """One row per id: ``doc, form`` (with ``keep_text``), ``form_fp, text_fp, changed, has_visible, n_mixed, n_whole``.

    A map over the texts; the row kept per id is chosen on fingerprints, so texts are not shuffled unless
    an id was delivered with different ones.
    """

    def digest(t: str) -> bytes:
        return hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                if t is None:
                    rows.append((None, None, None, False, False, 0, 0))
                    continue
                tally: dict[str, int] = {}
                form = normalize(t, tally)
                a = digest(t)
                rows.append((form, a if form == t else digest(form), a, form != t, visible(form), tally.get("mixed", 0), tally.get("whole", 0)))
            form, fp, own, changed, seen, mixed, whole = (list(c) for c in zip(*rows, strict=True)) if rows else [[]] * 7
            cols = [b.column("doc"), b.column("version"), pa.array(fp, pa.binary()), pa.array(own, pa.binary()), pa.array(changed, pa.bool_()), pa.array(seen, pa.bool_()), pa.array(mixed, pa.int32()), pa.array(whole, pa.int32())]
            names = ["doc", "version", "form_fp", "text_fp", "changed", "has_visible", "n_mixed", "n_whole"]
            if keep_text:
                cols.append(pa.array(form, pa.string()))
                names.append("form")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    version = F.unix_micros(F.col(version_col).cast("timestamp")) if version_col else F.lit(0).cast("long")
    src = df.select(F.col(id_col).cast("long").alias("doc"), version.alias("version"), F.col(text_col).alias("text")).where("doc is not null")
    out = src.mapInArrow(work, "doc long, version long, form_fp binary, text_fp binary, changed boolean, has_visible boolean, n_mixed int, n_whole int" + (", form string" if keep_text else ""))
    cols = ["form_fp", "text_fp", "changed", "has_visible", "n_mixed", "n_whole", *(["form"] if keep_text else [])]
    one = out.groupBy("doc").agg(F.max_by(F.struct(*cols), F.struct("version", "text_fp")).alias("x"))
    return one.select("doc", *[f"x.{c}" for c in cols])


def look_alikes(forms: DataFrame) -> DataFrame:
    """Pairs ``(doc_id_a, doc_id_b)`` of different texts with one form.

    Only forms that several different texts share meet in the join; equal texts give no pair.
    """
    seen = durable(forms.where("has_visible").select("doc", "form_fp", "text_fp"), "forms")
    shared = seen.groupBy("form_fp").agg(F.min("text_fp").alias("lo"), F.max("text_fp").alias("hi")).where("lo < hi").select("form_fp")
    some = salted_join(seen, seen.groupBy("form_fp").agg(F.count("*").alias("n")).join(shared.select("form_fp"), "form_fp"), "form_fp", "n")
    met = self_pairs(some, "form_fp", "doc", "l.text_fp <> r.text_fp")
    return met.select(F.col("l.doc").alias("doc_id_a"), F.col("r.doc").alias("doc_id_b"))
