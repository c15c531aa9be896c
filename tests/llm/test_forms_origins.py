"""Consistent forms of look-alike texts, and the origin of files."""

import pytest

from codegrain.llm import origin as o
from codegrain.llm.confusables import look_alikes, normalize, normalized


@pytest.mark.parametrize(
    ("odd", "plain"),
    [
        ("ｆｕｌｌ　ｗｉｄｔｈ", "full width"), ("cafe\u0301", "caf\u00e9"), ("ze\u200bro\ufeff", "zero"), ("a\u00a0b\u2009c", "a b c"), ("x\u2011y\u2010z", "x-y-z"), ("раураl", "paypal"),
        ("ﬁle", "file"), ("\u212a", "K"), ("ѕсоре", "scope"), ("Ηello", "Hello"), ("tab\tand\nline\r\n", "tab\tand\nline\r\n"), ("soft\u00adhyphen", "softhyphen"), ("\u037e", ";"),
    ],
)
def test_forms(odd, plain):
    assert normalize(odd) == plain


def test_other_scripts_keep_their_spelling():
    for word in ("привет", "словарь", "ёлка", "Ελλάδα", "旧的", "từ_điển"):
        assert normalize(word) == word
    assert normalize("слoвapь") == "словарь"  # Latin o, a, p inside
    for a, b in (("Case", "case"), ("é", "e"), ("a  b", "a b"), ("a\tb", "a b"), ("l", "1"), ("O", "0")):
        assert normalize(a) != normalize(b)


@pytest.mark.parametrize(
    ("odd", "plain", "verdict"),
    [
        ("\u03b1pple", "apple", "mixed"), ("\u03f2ode", "code", ""), ("\u0475ector", "vector", "mixed"), ("\u13da\u13a2\u13aa\u13a1\u13a2", "START", "whole"), ("\u2c98\u2c9e\u2ca6", "MOT", "whole"), ("\ua4dd\ua4f2\ua4da", "FIC", "whole"),
        ("\u0261rid", "grid", ""), ("\u0441\u043e\u0440\u0435", "cope", "whole"), ("\u03c3\u03bf\u03c6\u03cc\u03c2", "\u03c3\u03bf\u03c6\u03cc\u03c2", ""), ("slo\u0432o", "\u0455\u04cf\u043e\u0432\u043e", "mixed"), ("\u0441\u043bo\u0432\u03bf", "\u0441\u043b\u043e\u0432\u043e", "mixed"),
    ],
)
def test_script_sets(odd, plain, verdict):
    tally = {}
    assert normalize(odd, tally) == plain and normalize(plain) == plain
    assert list(tally) == ([verdict] if verdict else [])


def test_forms_are_stable():
    import random

    rng = random.Random(2)
    letters = "aopcxyTHB\u0430\u043e\u0440\u0441\u0443\u04af\u0432\u044c\u03bf\u03b1\u03c3\u03c6\u0391\u0392\u13aa\ua4d0\u0561\u0585\u65e7\u0301"
    for _ in range(5000):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))
        assert normalize(normalize(w)) == normalize(w)


def test_look_alike_pairs(spark):
    rows = [(1, "paypal x"), (2, "раураl x"), (3, "paypal x"), (4, "PayPal x"), (5, "\u200b"), (6, "\u200c"), (7, None), (8, ""), (2, "раураl x"), (None, "paypal x")]
    df = spark.createDataFrame([(i, t, "f", "g") for i, t in rows], "doc_id long, text string, form string, doc string")
    forms = normalized(df, "doc_id", "text")
    assert {tuple(r) for r in look_alikes(forms).collect()} == {(1, 2), (2, 3)}
    assert {r["doc"]: r["form"] for r in forms.collect()}[7] is None
    assert look_alikes(normalized(df.where("false"), "doc_id", "text")).count() == 0


@pytest.mark.parametrize(
    ("path", "says"),
    [
        ("corpus/raw/go/a__b__vendor_libx-1.2.3_f.go", "vendored"), ("corpus\\raw\\c\\a__b__node_modules\\q-2.0.1\\f.c", "vendored"), ("corpus/raw/py/a/b/app/_vendor/symlib/f.py", "vendored"),
        ("corpus/raw/py/a__b__libs_mod_1.2.3_f.py", "vendored"), ("corpus/raw/py/a__b__app_models_vendor_pipe.py", ""), ("corpus/raw/py/a__b__src_external_lane_client.py", ""),
        ("corpus/raw/py/a__b__third_party_b-1.0.0_f.py", ""), ("corpus/raw/py/a__b__lib_core.py", ""), (None, ""), ("raw/py/a__b__x_pb2.py", "generated"),
    ],
)
def test_what_paths_say(path, says):
    assert o.said_by_path(path) == says


@pytest.mark.parametrize(
    ("line", "says"),
    [
        ("// Code generated by toolx v1.2. DO NOT EDIT.", "generated"), ("# Diese Datei wurde automatisch aus a.idl erzeugt, nicht bearbeiten", "generated"), ("# Fichier produit par toolx 2.1, ne pas modifier", "generated"),
        ("// Used to be generated from a.idl, edited by hand since 2013.", "kept"), ('// "Generated by toolx, do not edit" + name', ""), ("// We dropped the vendored q library here and wrote our own.", ""),
        ("// Vendored: upstream own/lib @ 4579c463", "vendored"), ("# bundled copy of lib 1.2.3 (origin: someone)", "vendored"), ("# bundled copy of mine 1.2.3 (origin: me)", ""),
        ("// lib v9.5.6, embedded here so that no package download is needed", "vendored"), ("// (c) 2012 the own/lib project. Free to use.", ""),
    ],
)
def test_what_heads_say(line, says):
    assert o.said_by_head(o.head_lines(line + "\nimport x\n"), "me", "mine") == says


def test_origins_of_files(spark):
    plain = "import a\n\ndef f(x):\n    y = g(x) + h(1)\n    return y if x else None\n\nclass B:\n    z = [1, 2]\n"
    made = lambda n: "".join(f'_register("{n}.A{i}", {i}, 0x{i:04x}, v_{i});\n' for i in range(40))
    table = "const t = [\n" + "".join(f"  {i}, 0x{i:02x}, {i * 3},\n" for i in range(60)) + "];\n"
    mini = "".join(f"function a{i}(b,c){{return b.x(c|{i})}}" for i in range(60))
    lock = "".join(f'[[package]]\nname = "p{i}"\nversion = "1.{i}.0"\nchecksum = "{i:032x}"\n\n' for i in range(10))
    rows = [
        (1, "raw/python/a__b__f.py", plain, "python", None), (2, "raw/c/a__b__g.c", made("x"), "c", None), (3, "raw/c/c__d__g.c", made("y"), "c", None), (4, "raw/js/a__b__t.js", table, "javascript", None),
        (5, "raw/js/a__b__m.js", mini, "javascript", None), (6, "raw/toml/a__b__pins.toml", lock, "toml", None), (7, "raw/js/a__b__node_modules_q-1.0.0_i.js", plain, "javascript", None),
        (8, None, None, None, None), (9, None, "", None, None), (10, "raw/python/a__b__v.py", "# Vendored: upstream z/q @ 0123456\n" + plain, None, None), (None, None, made("x"), None, None),
        (11, "raw/python/z__q__f.py", plain, "python", None),  # the same in another repository: clusters across repositories indicate vendoring
        (12, "raw/go/c__d__w.go", "// Vendored: upstream k/l @ 7654321\nvar w = [3]int{7, 8, 9}\n", "go", None),  # so do notices of one wording
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in [*rows, rows[1]]], "file_id long, path string, text string, lang string, ingested_at timestamp, origin string, doc string")
    got = {r["doc"]: (r["origin"], r["family_files"]) for r in o.origins(df, "file_id", "path", "text", "lang", "ingested_at").collect()}
    assert {k: v[0] for k, v in got.items()} == {1: None, 2: "generated", 3: "generated", 4: "data", 5: "minified", 6: "data", 7: "vendored", 8: None, 9: None, 10: "vendored", 11: None, 12: "vendored"}
    assert got[2][1] == got[3][1] == 2
    assert o.origins(df.where("false"), "file_id", "path", "text", "lang").count() == 0
