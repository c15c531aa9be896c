"""Featuriser: golden vectors, an independent fold, and the text put together again."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codegrain.functions import featurize as fz
from codegrain.functions import lexing as lx
from codegrain.functions.shingles import shingle_sets, text_buffers, word_hashes
from codegrain.schemas import LAYOUTS, layout

GOLDEN = {"foo": (292, 36, 804, 111, 239), "return": (81, 81, 593, 87, 87), "HttpServer": (381, 125, 381, 126, 126), "MAX_N": (58, 58, 570, 84, 212), "élève": (94, 94, 94, 69, 197), "🚀🚀": (40, 40, 552, 37, 165)}
SCAN = re.compile("\r\n|\n|\r|[\t\x0b\x0c ]+|[0-9A-Za-z_\x80-\U0010ffff]+|.", re.S)


def features(texts, name):
    return fz.features(*text_buffers(pa.array(texts)), name)


def test_golden_hashes():
    for word, want in GOLDEN.items():
        a, b = fz.Tokens(*text_buffers(pa.array([word]))).word_hashes()
        assert (a[0] & 511, a[0] & 255, a[0] & 1023, b[0] & 127, b[0] & 255) == want


def test_hash_columns_agree(spark):
    df = spark.createDataFrame([(w,) for w in GOLDEN], "w string")
    got = {r[0]: (r[1] & 511, r[2] & 127) for r in df.select("w", *[lx.word_hash(F.col("w"), *h) for h in fz.HASHES]).collect()}
    assert got == {w: (v[0], v[3]) for w, v in GOLDEN.items()}


def test_golden_pairs():
    for text, want in (("()", 30), ("=>", 9), ("};", 20)):
        assert features([text], "compact_v1")["sym_prev"][1] == want
    assert features(["f("], "compact_v1")["sym_prev"][1] == 16
    assert features(["=>"], "compact_v1")["trans_prev"].tolist() == [0, 5]
    assert [features([" " * w + "x"], "compact_v2")["indent"][0] for w in (4, 5, 9, 13, 17)] == [3, 4, 5, 6, 7]


def adversarial(n=400):
    rng = random.Random(1)
    alphabet = list("abZ1_ \t\n\r\x0b{}[]()\"'`\\/*=>.#éЖ🚀\x00\x7f")
    fixed = ["", " ", "\r\n\r\n", "x", "}}{{", "   \t a", "\\'\\\\'x'", '"a\\"b"\n(', "{" * 600, *("t " * k for k in (31, 32, 33, 511, 512, 513))]
    return fixed + ["".join(rng.choices(alphabet, k=rng.randint(0, 90))) for _ in range(n)]


def test_tokens_tile_the_text():
    texts = adversarial()
    f = features(texts, "compact_v1")
    for i, t in enumerate(texts):
        at = f["row"] == i
        assert [t[s:e] for s, e in zip(f["start"][at], f["end"][at], strict=True)] == SCAN.findall(t)


def test_scan_column_agrees(spark):
    texts = [t for t in adversarial(60) if "\x00" not in t]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(lx.scan(F.col("t"))).collect()]
    assert got == [SCAN.findall(t) for t in texts]


def fold(text):
    """Kept tokens with their structure, one step at a time."""
    out, nl, sp, width, tab, mark, brace, paren = [], 1, False, 0, False, None, 0, 0
    deep, quote, escaped, place = [0, 0, 0], 0, False, 0
    for m in SCAN.finditer(text):
        c = m.group()[0]
        if c in "\r\n":
            nl, width, tab, mark, place, escaped = nl + 1, 0, False, None, 0, False
            continue
        if c in "\t\x0b\x0c ":
            sp = True
            if mark is None:
                width += sum(4 if x == "\t" else 1 for x in m.group())
                tab = tab or "\t" in m.group()
            continue
        word = not c.isascii() or c.isalnum() or c == "_"
        mark = (0 if word else fz.LINE_FIRST.find(c) + 1) if mark is None else mark
        row = {"gap_prev": 3 if nl >= 2 else 2 if nl == 1 else int(sp), "line_first": mark, "indent": width if width <= 2 else 3 if width <= 4 else 4 + (width - 5) // 4 if width <= 16 else 7}
        brace -= c == "}" and brace > 0
        paren -= c in ")]" and paren > 0
        row |= {"brace_depth": min(3, brace), "paren_depth": min(3, paren), "tab": tab}
        brace += c == "{"
        paren += c in "(["
        row["large"] = (*(min(7, x) for x in deep), min(7, place), quote)
        if c in "'\"`" and not escaped:
            mine = "'\"`".index(c) + 1
            quote = 0 if quote == mine else mine if quote == 0 else quote
        elif quote == 0 and c in "(){}[]":
            i, up = "(){}[]".index(c) // 2, c in "({["
            deep[i] = max(0, deep[i] + (1 if up else -1))
        escaped = c == "\\" and not escaped
        place, sp, nl = place + 1, False, 0
        out.append(row)
    return out


def test_structure_equals_the_fold():
    texts = adversarial(1200)
    f, g = features(texts, "compact_v2"), features(texts, "large_v2")
    for i, t in enumerate(texts):
        want = fold(t)
        at = np.flatnonzero(f["row"] == i)
        assert len(at) == len(want)
        for j, w in zip(at, want, strict=True):
            assert all(f[k][j] == w[k] for k in ("gap_prev", "line_first", "indent", "brace_depth", "paren_depth")), t
            assert ((f["flags"][j] & 32) > 0) == w["tab"]
            assert tuple(g[k][j] for k in ("paren_depth", "brace_depth", "bracket_depth", "line_pos", "quote_state")) == w["large"], t


def test_fields_are_bounded_and_words_unpack():
    for name, lay in LAYOUTS.items():
        f = features(adversarial(), name)
        for field, n in lay.fields.items():
            assert f[field].min() >= 0 and f[field].max() < n, (name, field)
        w = fz.pack(f, name)
        assert ((w["w0"] & 3) == f["kind"]).all() and ((w["w0"] >> 19 & 255) == f["flags"]).all() and (w["w0"] >> 27 == f["sym_next"]).all()
        assert ((w["w1"] & 1023) == f["hash1"]).all() and (w["w1"] >> (26 if lay.large else 25) == f["sym_prev"]).all()
        if name == "large_v2":
            assert ((w["w2"] >> 24) == f["quote_state"]).all() and ((w["w2"] >> 7 & 31) == f["line_first"]).all()


def test_unknown_version_is_refused():
    with pytest.raises(ValueError, match="unknown feature version"):
        layout("compact", 3)


def test_token_rows_of_empty_and_null(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "a b", "z")], "id int, text string, tok_ix2 string")
    rows = fz.token_rows(df, "id", "text", "compact_v2", ["kind"], "tok_ix2").collect()
    assert [(r["id"], r["tok_ix"], r["tok_ix2"]) for r in rows] == [(3, 0, "z"), (3, 1, "z")]


def test_words_and_shingles_over_segments(monkeypatch):
    from codegrain.functions import shingles as sh

    texts = adversarial(200)
    whole = word_hashes(*text_buffers(pa.array(texts)))
    monkeypatch.setattr(sh, "SEGMENT", 16)
    small = word_hashes(*text_buffers(pa.array(texts)))
    assert (whole[0] == small[0]).all() and (whole[1] == small[1]).all()
    words = re.compile(r"[0-9A-Za-z_\x80-\U0010ffff]+")
    for lo, n_words, bounds, h in shingle_sets(pa.array(texts), 3):
        for i in range(len(n_words)):
            w = words.findall(texts[lo + i])
            assert n_words[i] == len(w) and bounds[i + 1] - bounds[i] == len({tuple(w[j : j + 3]) for j in range(len(w) - 2)})
            assert (np.diff(h[bounds[i] : bounds[i + 1]].astype(np.int64)) > 0).all()
