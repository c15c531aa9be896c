"""Families of units: exact within buckets, closed over links, and what they decide."""

import numpy as np
import pyarrow as pa
import pytest

from codegrain.functions.shingles import text_buffers
from codegrain.llm import origin as o


def sets(*ranges):
    return [np.arange(a, b, dtype=np.uint64) * np.uint64(0x5DEECE66D) % np.uint64(1 << 40) for a, b in ranges]


def members(rows):
    cols = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["coarse", "meet", "doc", "shingles"])


def test_members_that_fail_the_first_one_are_linked():
    x = [np.sort(s).tobytes() for s in sets((0, 100), (1000, 1200), (1010, 1210))]
    rows = [(7, 0, i + 1, s) for i, s in enumerate(x)] + [(8, 1, i + 1, s) for i, s in enumerate(x)]
    parts = [members(rows[:2]), members(rows[2:])]  # a place may lie in two batches
    got = [r for b in o._links(iter(parts)) for r in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)]
    assert got == [(3, 2), (3, 2)]


def test_sketches_of_alike_sets_are_near():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(5, 300))
        a = rng.integers(0, 1 << 40, n, dtype=np.uint64)
        b = np.concatenate((a[: -(-8 * n // 9)], rng.integers(0, 1 << 40, n - -(-8 * n // 9), dtype=np.uint64)))  # 0.8 or more
        x = np.frombuffer(b"".join(o.sketches(np.concatenate((a, b)), np.array([n, n]))), np.uint64).reshape(2, -1)
        assert o.near(x, np.array([n, n])).tolist() == [0, 0]
    far = np.frombuffer(b"".join(o.sketches(np.arange(600, dtype=np.uint64), np.array([300, 300]))), np.uint64).reshape(2, -1)
    assert o.near(far, np.array([300, 300])).tolist() == [0, 1]


def test_components_equal_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        base = [rng.choice(400, rng.integers(4, 60), replace=False) for _ in range(4)]
        some = [np.unique(np.where(rng.random(len(b)) < 0.05, rng.integers(0, 400, len(b)), b)).astype(np.uint64) for b in base for _ in range(rng.integers(1, 6))]
        of = list(range(len(some)))
        for i in range(len(some)):
            for j in range(i):
                both = len(np.intersect1d(some[i], some[j]))
                if 5 * both >= 4 * (len(some[i]) + len(some[j]) - both):
                    a, b = of[i], of[j]
                    of = [min(a, b) if x in (a, b) else x for x in of]
        assert o._components(some).tolist() == of


def test_signatures_are_those_of_each_set():
    x = sets((0, 5), (7, 300), (2, 3))
    whole = o.signatures(np.concatenate(x), np.array([len(s) for s in x]), o.BANDS, o.ROWS, at_once=8)
    for i, s in enumerate(x):
        assert (o.signatures(s, np.array([len(s)]), o.BANDS, o.ROWS)[0] == whole[i]).all()


def test_windows_of_one_file_are_families():
    table = "".join(f"  f({i}, 0x{i:02x}, g_{i});\n" for i in range(60))
    blob = "x = [\n" + "".join('  "' + "aZ9+/b" * 12 + str(i) + '",\n' for i in range(60)) + "]\n"
    rng = np.random.default_rng(1)
    loose = " ".join("".join(rng.choice(list("(){}[];,.+-*/<>=&|!a1"), 6)) for _ in range(300))
    f = o.frames(*reversed(text_buffers(pa.array([table, loose, "", None, blob, "a"]))))
    assert f.inner[0] > 0.8 and f.inner[1] == 0 and f.inner[2] == 0 and f.inner[4] > 0.7 and f.inner[5] == 0


def test_families_are_closed_over_links(spark):
    body = lambda a: "".join(f"x{'+-*/%&|^'[i % 8]}{'<>=!'[i // 8 % 4]}(y[{'!' * (i // 32)}z]);\n" for i in range(a, a + 120))
    rows = [(i + 1, f"raw/c/a__b{i}__f.c", body(x), "c") for i, x in enumerate((0, 9, 18, 27, 300, 300))] + [(9, "raw/c/a__b__f.c", "", "c")]
    got = run(spark, rows)
    assert {d: r["family"] for d, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 9: 9}


COLS = "id long, path string, text string, lang string"


def run(spark, rows):
    return {r["doc"]: r for r in o.origins(spark.createDataFrame(rows, COLS), "id", "path", "text", "lang").collect()}


PLAIN = "import a\n\ndef f(x):\n    y = g(x) + h(1)\n    return y if x else None\n\nclass B:\n    z = [1, 2]\n"


def test_copies_of_written_files_are_families(spark):
    got = run(spark, [(1, "raw/python/a__b__f.py", PLAIN, "python"), (2, "raw/python/c__d__g.py", PLAIN.replace("x", "other").replace("B", "Named"), "python"), (3, "raw/python/c__d__h.py", PLAIN, "python")])
    assert {(d, r["origin"], r["family"], r["family_files"], r["family_projects"], r["own_files"]) for d, r in got.items()} == {(1, None, 1, 3, 2, 1), (2, None, 1, 3, 2, 2), (3, None, 1, 3, 2, 2)}


def test_nothing_is_a_case_without_a_family(spark):
    alone = [(1, "raw/python/a__b__node_modules_q-1.0.0_i.py", PLAIN, "python"), (2, "raw/c/a__b__g.c", "// Code generated by toolx v1.2. DO NOT EDIT.\nint f(int a) { return a; }\n", "c")]
    assert {r["origin"] for r in run(spark, alone).values()} == {None}
    more = [*alone, (3, "raw/python/q__q__i.py", PLAIN, "python"), (4, "raw/go/c__d__h.go", "// Code generated by other v7.0. DO NOT EDIT.\nvar x = [2]string{}\n", "go")]
    assert {d: r["origin"] for d, r in run(spark, more).items()} == {1: "vendored", 2: "generated", 3: None, 4: "generated"}


@pytest.mark.parametrize(
    ("line", "says"),
    [
        ("# File created with love by Bob", ""), ("// This code was generated by hand-written rules", ""), ("// Do not modify the order of these imports", ""), ("# Source: docs/x @ home", ""),
        ("// Fichero creado autom\u00e1ticamente por toolx", "generated"), ("# Synced with upstream acme/lib at v1.2", "vendored"), ("# Do not edit.", "generated"), ("# Source: z/q @ 0123456", "vendored"),
    ],
)
def test_statements(line, says):
    assert o.said_by_head(o.head_lines(line + "\nimport x\n"), "me", "mine") == says


def test_heads_are_read_to_their_end():
    licence = "".join(f" * line {i} of a licence\n" for i in range(80))
    assert o.said_by_head(o.head_lines("/*\n" + licence + " */\n\n// Code generated by toolx v1. DO NOT EDIT.\nint x;\n"), "", "") == "generated"
    assert o.head_lines("/*\nplain line\n  other\n*/\nint x; // no\n") == ["", "plain line", "other", ""]
    assert o.head_lines('"""One line."""\nx = 1\n') == ["One line."]


def test_names_in_lines_are_one_sign():
    a, b, c = (o.line_form(x) for x in ("Code generated by toolx v1.2 from `a b`", "Code generated by other v7 from (z.idl)", "Code written for people"))
    assert a == b != c
    assert o.line_form("") is None and o.line_form("---") is None
