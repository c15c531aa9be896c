"""Problem 4: generated, minified, vendored and data files among source files.

Units of every file are masked and clustered.  Whole texts, as shingles of five masked words with the marks
behind each, are banded by MinHash; all links of a bucket are verified on whole sets, and families are the
components of the links.  Windows of ``WINDOW`` tokens of one text are banded and verified in the task that
reads it.  Comment lines at a head are one family if they are equal once names are masked (plain words stay).
What a file's families are decides what it can be:

* a family within one repository (its whole text like another file there, most of its windows like others
  of its own, or its notice worded like that of other files) indicates generation or compaction;
* a cluster across repositories indicates that it was taken over;
* a family of literals only indicates data.

No file is a case without such a family.  An exact check follows, because by the definition likeness alone is
no case: of the path and the head for files taken over, of the head, the recurring share or the lines for
generated and compacted ones, of checksums, encoded runs or literals for data.

Statements count where tools and people put them: in the comment lines at the head of a file, at the start
of a line.  The same words further down, in quotes or in the past tense are talk about such files.

Defined results: null texts and blank texts are never cases; null paths say nothing and belong to no
repository (such a file is a repository of its own); ids count once (the latest delivered); an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegrain.functions.shingles import _WORD, mix64, row_chunks, text_buffers
from codegrain.llm.similarity import bitmap, with_slot
from codegrain.operators.durable import durable
from codegrain.operators.graph import connected_components
from codegrain.operators.ordered import salted_join

K = 5
WINDOW = 64  # tokens of a window; a template of up to some fifty tokens shows as alike windows
BANDS, ROWS = 14, 6  # two units at the least similarity share a band with a probability of 0.986
INNER_BANDS, INNER_ROWS = 8, 3  # the same for windows of one file, compared where they are read: 0.997
NUM, DEN = 4, 5  # similarity of shingle sets
PER_BLOCK = 2_000  # members that meet at once
CARRIES, ALONE = 0.72, 0.8  # recurring share of a file: if the whole file has a family, and if its windows have one
INNER = 0.5  # share of a file in windows that have a family
TABLE = 40  # frames of marks or statements up to this size come from a tool, hand-written ones vary more
BLOB = 0.5  # share of a file in long unbroken runs of encoded data

# ------------------------------------------------------------------ what a path or a notice says

#: Folders that hold other projects' files by convention.
FOREIGN_DIRS = ("node_modules", "bower_components", "jspm_packages", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "_vendor", "Pods", "Carthage", "Godeps", "subprojects", "site-packages", "dist-packages")
#: Folders that do so if a project's name and version follow.
MAYBE_DIRS = ("vendor", "vendored", "vendors", "external", "externals", "extern", "ext", "deps", "dependencies", "contrib", "libs", "lib", "packages", "pkg", "submodules", "modules", "imports", "upstream", "bundled", "thirdparty")

_SEP = r"(?:__|[/\\_])"
_VERSION = r"v?\d+\.\d+(?:\.\d+)*(?:[-.]?(?:rc|beta|alpha|pre)[.\d]*)?"
_STRONG = re.compile(r"(?:^|__|[/\\_])(" + "|".join(map(re.escape, FOREIGN_DIRS)) + r")" + _SEP + r"+([A-Za-z0-9.@-]+)", re.I)
_WEAK = re.compile(r"(?:^|__|[/\\_])(" + "|".join(map(re.escape, MAYBE_DIRS)) + r")" + _SEP + r"([A-Za-z][A-Za-z0-9.@-]*?)(?:-|" + _SEP + r")" + _VERSION + r"(?=" + _SEP + ")", re.I)
_GENERATED_NAME = re.compile(r"(?:_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|cc|h)|\.designer\.\w+|\.g\.\w+|\.generated\.\w+|_generated\.\w+|\.tab\.[ch]\w*|\.freezed\.dart)$|(?:__|[/\\_])_*generated_*(?:__|[/\\_])", re.I)
_MIN_NAME = re.compile(r"[.-]min\.(?:js|mjs|css)$|\.bundle\.(?:js|css)$", re.I)

_LEAD = re.compile(r"^\s*(?://[/!]*|#+!?|/\*+!?|\*+(?!/)|--+|<!--|;+|%+|\{-|\(\*|\"\"\"|''')\s?")
_TRAIL = re.compile(r"\s*(?:\*/|-->|-\}|\*\)|\"\"\")\s*$")
_SKIP = re.compile(r"^\s*(?:<\?php|<\?xml.*|#!.*|\"use strict\";?|package \w+;?|<!doctype.*)?\s*$", re.I)

#: Statements of a tool about its output, at the start of a comment line.
_BY_TOOL = re.compile(
    r"""^(?:
      @generated\b | <auto-?generated | auto-?\s?generated\b | machine[- ](?:written|made|generated)\b
    | (?:this\ (?:file|code|source|module|class|header)\ (?:is|was|has\ been)\ )?(?:automatically\ |auto-?|machine[- ])?generated\ (?:by|from|on|with|using|at|file|code|source)\b(?!\ (?:hand|love|care))
    | (?:this\ )?(?:code|file|source|header)\ (?:is\ |was\ |has\ been\ )?(?:auto(?:matically)?[- ]?)?(?:generated|produced|emitted)\ (?:automatically|by|from|with|using)\b(?!\ (?:hand|love|care))
    | (?:this\ )?(?:code|file|source|header)\ (?:is\ |was\ |has\ been\ )?(?:auto(?:matically)?[- ]?(?:created|written)|(?:created|written)\ (?:automatically|by\ (?:a|the)\ (?:tool|generator|compiler|script)))\b
    | output\ of\ \S+ | produced\ by\ \S+\ v?\d | emitted\ by\ \S+
    | .*(?:created|produced|made)\ automatically\ by\b
    | (?:diese|dieser)\ \w+\ wurde\ .*(?:erzeugt|generiert|erstellt) | automatisch\ (?:erzeugt|generiert)
    | (?:ce\ )?(?:fichier|code)\ .*(?:produit|généré|cree|créé)\ (?:automatiquement|par)\b
    | (?:este\ )?(?:archivo|fichero|código|ficheiro|arquivo)\ .*(?:generado|gerado|cread[oa]\ autom\w+|criado\ autom\w+)\b
    | (?:questo\ )?file\ .*generato\b | (?:ten\ )?plik\ .*wygenerowan
    | .*(?:автоматически\ (?:создан|сгенерирован)|сгенерирован) | .*(?:自动生成|自動生成) | .*tự\ động\ tạo
    | (?:warning|note|attention)[:!]\ .*(?:auto-?|automatically\ )generated
    | do\ not\ (?:edit|modify)(?:\ this\ file|\ by\ hand|\ manually|\s*[-.!,;:(]|\s*$)
    )""",
    re.I | re.X,
)
#: What unsays such a statement.
_KEPT_BY_HAND = re.compile(r"\b(?:used to be|no longer|formerly|originally|once|first draft|initially)\b|by hand (?:ever )?since|kept up by hand|edited by hand|maintained by hand", re.I)
#: Statements that a file was taken over, at the start of a comment line.
_TAKEN = re.compile(
    r"""^(?:
      vendored(?:\ (?:copy|from|in)|:)
    | (?:a\ )?(?:bundled|verbatim|unmodified|unchanged|local|embedded|vendored|pristine)\ copy\ of\b
    | (?:this\ (?:file|code)\ (?:is|was)\ )?(?:copied|taken|imported|mirrored|synced|synchroni[sz]ed|extracted|borrowed|lifted|pulled)\b(?:\ (?:as\ is|verbatim|over|unchanged|unmodified|directly))*\ (?:from|with\ upstream)\b
    | upstream(?:\ source)?:\ \S+ | origin:\ \S+ | source:\ \S+/\S+\ @\ ?(?:v?\d|[0-9a-f]{7})
    | \S+\ v?\d+\.\d+\S*,?\ (?:embedded|bundled|included|vendored|shipped|copied|inlined)\ (?:here|verbatim|as\ is|unchanged)\b
    )""",
    re.I | re.X,
)
_NAMES = re.compile(r"([A-Za-z][\w.-]*)/([A-Za-z][\w.-]*)|\b(?:of|from(?: the)?|upstream) ([A-Za-z][\w.-]*)|^([A-Za-z][\w.-]*) v?\d+\.\d")
_BY = re.compile(r"(?:\(origin: ?|\bby )([\w.-]+)")
_LOCK = re.compile(r"\"?(?:integrity|checksum|resolved|sha256|sha512|hash|digest|content-hash)\"?\s*[:=]\s*\"?(?:sha\d*[-:])?[0-9A-Za-z+/=:.-]{16,}|^\S+ v?\d+\.\d+\.\d+\S* (?:h1:|sha\d+:)", re.I | re.M)
_LOCK_WORDS = ("integrity", "checksum", "resolved", "sha256", "sha512", "hash", "digest", " h1:", " sha")
#: Files that are lists of settings, rules or marks by nature, by extension or language.
_PLAIN = frozenset("json json5 yaml yml toml css scss sass less markdown md mdx rst txt text shell sh bash zsh bat hcl tf ini cfg conf properties make makefile mk dockerfile csv tsv".split())
_MARKS = frozenset("html htm xhtml xml svg vue sql".split())
_PIN = re.compile(r"\"?version\"?\s*[:=]\s*\"?v?\d+\.\d+|@v?\d+\.\d+\.\d+|==\d+\.\d+| v\d+\.\d+\.\d+", re.I)


def _slim(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def own_project(path: str | None) -> tuple[str, str]:
    """Owner and repository of a path, slimmed; empty if it has none."""
    m = re.search(r"(?:^|[/\\])raw[/\\]+[^/\\]+[/\\]+(.+)$", path or "", re.I)
    parts = re.split(r"__|[/\\]", m.group(1)) if m else []
    if len(parts) < 3:
        return "", ""
    repo = parts[1].strip()
    return _slim(parts[0]), _slim(repo[:-4] if repo.lower().endswith(".git") else repo)


def inner_path(path: str | None) -> str:
    """The path below the repository, or all behind the language folder."""
    m = re.search(r"(?:^|[/\\])raw[/\\]+[^/\\]+[/\\]+(.+)$", path or "", re.I)
    rest = m.group(1) if m else path or ""
    cut = re.match(r"(?:(?!__)[^/\\])+(?:__|[/\\])(?:(?!__)[^/\\])+(__|[/\\])", rest)
    # the separator stays, so that a folder name with a leading underscore keeps it
    return rest[cut.start(1) :] if cut else rest


def said_by_path(path: str | None) -> str:
    """``vendored`` if the path shows a foreign origin, else ``generated``, ``minified`` or ``""``."""
    if not path:
        return ""
    owner, repo = own_project(path)
    inner = inner_path(path)
    for found in (_STRONG.search(inner), _WEAK.search(inner)):
        if found:
            name = re.sub(r"-" + _VERSION + "$", "", found.group(2))
            if _slim(name) not in (repo, ""):
                return "vendored"
    if _GENERATED_NAME.search(inner):
        return "generated"
    return "minified" if _MIN_NAME.search(inner) else ""


#: Signs that open a comment of several lines, and those that close it.
_BLOCKS = {"/*": "*/", "<!--": "-->", "(*": "*)", "{-": "-}", '"""': '"""', "'''": "'''"}
_INSIDE = re.compile(r"^\s*(?:\*+(?!/))?\s*")


def head_lines(text: str) -> list[str]:
    """All comment lines at the head of a text, without comment signs; a block comment to its end."""
    out: list[str] = []
    at, shut = 0, ""
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end].rstrip("\r")
        at = end + 1
        if shut:
            body = line[_INSIDE.match(line).end() :]
        else:
            lead = _LEAD.match(line)
            if not lead or line.startswith(("#include", "#define", "#!", "#if")):
                if _SKIP.match(line):
                    continue
                break
            body = line[lead.end() :]
            sign = lead.group().strip()
            shut = next((c for o, c in _BLOCKS.items() if sign.startswith(o)), "")
        if shut and shut in body:
            body, shut = body[: body.index(shut)], ""
        out.append(_TRAIL.sub("", body).strip())
    return out


def statements(lines: list[str], owner: str, repo: str) -> list[str]:
    """What each line states of the file: ``generated``, ``vendored``, ``kept`` or nothing."""
    out = []
    for line in lines:
        says = ""
        if _KEPT_BY_HAND.search(line):
            says = "kept"
        elif _BY_TOOL.match(line):
            says = "generated"
        elif _TAKEN.match(line):
            owners, names = set(), set()
            for a, b, c, d in _NAMES.findall(line):
                owners |= {_slim(a)} if a else set()
                names |= {_slim(x) for x in (b, c, d) if x}
            owners |= {_slim(x) for x in _BY.findall(line)}
            # the project's own name, or its owner without any name, is no foreign origin
            says = "" if owner and (repo in names or (not names and owner in owners)) else "vendored"
        out.append(says)
    return out


def said_by_head(lines: list[str], owner: str, repo: str) -> str:
    """What the first statement says; ``kept`` if any line takes such statements back."""
    says = statements(lines, owner, repo)
    return "kept" if "kept" in says else next((s for s in says if s), "")


_TERM = re.compile(r"[^\s,;!()<>\[\]{}\"'`]+")
_QUOTED = re.compile(r"`[^`]*`|\([^()]*\)|\"[^\"]*\"")
#: Words before the name of a tool, project or file.
_BEFORE_NAMES = frozenset("by with of from using via par aus von mit con por".split())


def line_form(line: str) -> bytes | None:
    """Digest of a comment line with plain words kept and every name, path, version and number as one sign.

    A word is a name if it is not all letters of one case, if it is quoted or in brackets, or if it stands where names
    do, behind a colon or a word such as "by".
    """
    words: list[str] = []
    name = False
    for m in _TERM.findall(_QUOTED.sub(" 0 ", line)):
        w = m.strip(".-/*=#:")
        if w:
            plain = not name and w.isalpha() and (w.islower() or w.isupper() or w.istitle())
            w = w.lower() if plain else "0"
            words.append(w)
            name = m[-1] == ":" or w in _BEFORE_NAMES
    return _digest(" ".join(words).encode("utf-8", "surrogatepass")) if words else None


def is_lock(text: str) -> bool:
    """A resolved list: pinned versions with checksums, many of them."""
    low = text.lower()
    # each checksum has one of these words: too few of them need no search
    if sum(low.count(w) for w in _LOCK_WORDS) < max(3, len(text) / 220):
        return False
    sums = len(_LOCK.findall(text))
    return sums >= 3 and len(_PIN.findall(text)) >= 3 and sums * 220 >= len(text)


def kind_of(path: str | None, lang: str | None, text: str) -> str:
    """``plain`` (settings, rules), ``marks`` (markup, statements) or ``code``."""
    names = {(lang or "").lower(), path.rpartition(".")[2].lower() if path and "." in path else ""}
    if names & _MARKS:
        return "marks"
    if names & _PLAIN or (not any(names) and text.lstrip()[:1] in ("{", "[", "<", "")):
        return "plain"
    return "code"


# ------------------------------------------------------------------ frames


_MASK = np.uint64((1 << 40) - 1)
_CODED = _WORD.copy()
_CODED[[43, 47]], _CODED[128:], _CODED[95] = True, False, False
LONG_RUN = 40  # bytes of an unbroken run of encoded data, which is one literal


def masked_tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind (1 identifier, 2 number or run of encoded data, else the byte) and row of every token; blanks are no tokens.

    Last the bytes of each row that lie in such runs.
    """
    n = len(raw)
    word = _WORD[raw]
    first = np.zeros(n, bool)
    first[1:] = word[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = False
    begins = word & ~first
    mark = ~word & (raw > 32) & (raw != 127)
    at = np.flatnonzero(begins | mark)
    kind = raw[at].astype(np.uint64)
    digit = (kind >= 48) & (kind <= 57)
    is_word = word[at]
    kind[is_word & digit] = 2
    kind[is_word & ~digit] = 1
    row = np.searchsorted(offsets, at, "right") - 1
    # runs of encoded data: letters and digits with + and /, cut by marks at random places
    edge = np.flatnonzero(np.diff(np.concatenate(([0], _CODED[raw].astype(np.int8), [0]))))
    lo, hi = edge[::2], edge[1::2]
    long = hi - lo >= LONG_RUN
    coded = np.bincount(np.searchsorted(offsets, lo[long], "right") - 1, weights=(hi - lo)[long], minlength=len(offsets) - 1)
    if long.any():
        lo, hi = np.searchsorted(at, lo[long]), np.searchsorted(at, hi[long])
        step = np.zeros(len(at) + 1, np.int64)
        np.add.at(step, lo, 1)
        np.add.at(step, hi, -1)
        inside = np.cumsum(step)[:-1] > 0
        first = np.zeros(len(at), bool)
        first[lo[lo < len(at)]] = True
        kind[inside] = 2
        stay = ~inside | first
        kind, row = kind[stay], row[stay]
    return kind, row, coded


_ALL_WORDS = np.uint64(sum(1 << (8 * j) for j in range(K)))


@dataclass(frozen=True)
class Frames:
    """Per row: its set of shingles, how many of them recur (the frame), shares of the file, tokens."""

    sets: list[np.ndarray]
    size: np.ndarray
    carries: np.ndarray  # occurrences of recurring shingles, of all
    literals: np.ndarray  # literal tokens, of all
    n_tokens: np.ndarray
    inner: np.ndarray  # tokens in windows that have a family of windows of the same file, of all
    coded: np.ndarray  # bytes in long runs of encoded data


def frames(raw: np.ndarray, offsets: np.ndarray) -> Frames:
    rows_n = len(offsets) - 1
    kind, row, coded = masked_tokens(raw, offsets)
    n_tokens = np.bincount(row, minlength=rows_n)
    number = np.bincount(row[(kind == 2) | (kind == 34) | (kind == 39)], minlength=rows_n)
    if len(kind) < K:
        return Frames([np.zeros(0, np.uint64)] * rows_n, np.zeros(rows_n, np.int64), np.zeros(rows_n), number / np.maximum(n_tokens, 1), n_tokens, np.zeros(rows_n), coded)
    acc = np.zeros(len(kind) - K + 1, np.uint64)
    for j in range(K):
        acc = (acc << np.uint64(8)) | kind[j : len(kind) - K + 1 + j]
    ok = (row[: len(acc)] == row[K - 1 :]) & (acc != _ALL_WORDS)  # runs of words are prose
    key = np.sort((row[: len(acc)][ok].astype(np.uint64) << np.uint64(40)) | acc[ok])
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate((new, [len(key)])))
    of = (key[new] >> np.uint64(40)).astype(np.int64)
    per_row = np.bincount(of, weights=count, minlength=rows_n)
    often = count >= np.maximum(4, per_row[of] * 0.008)
    size = np.bincount(of[often], minlength=rows_n)
    share = np.bincount(of[often], weights=count[often], minlength=rows_n) / np.maximum(per_row, 1)
    first = np.searchsorted(row, np.arange(rows_n))
    slot = (np.arange(len(row)) - first[row]) // WINDOW
    begins = np.concatenate(([True], (row[1:] != row[:-1]) | (slot[1:] != slot[:-1])))
    window = np.cumsum(begins) - 1
    kin = alike_windows(window[: len(acc)][ok], acc[ok], row[begins])
    inner = np.bincount(row, weights=kin[window], minlength=rows_n) / np.maximum(n_tokens, 1)
    return Frames(word_shingles(kind, row, rows_n), size, share, number / np.maximum(n_tokens, 1), n_tokens, inner, coded)


def distinct(key: np.ndarray) -> np.ndarray:
    key = np.sort(key)
    return key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key


def word_shingles(kind: np.ndarray, row: np.ndarray, rows_n: int) -> list[np.ndarray]:
    """Per row, the set of its shingles of ``K`` masked words, each with the marks behind it."""
    word = np.flatnonzero(kind <= 2)
    if len(word) < K:
        return [np.zeros(0, np.uint64)] * rows_n
    at = np.maximum.accumulate(np.where(kind <= 2, np.arange(len(kind)), word[0]))  # the word a mark stands behind
    part = np.where(row == row[at], mix64(kind * np.uint64(0x9E3779B97F4A7C15) + (np.arange(len(kind)) - at).astype(np.uint64)), np.uint64(0))
    unit = np.add.reduceat(part, word)
    prose = unit == mix64(np.array([0x9E3779B97F4A7C15], np.uint64))[0]  # an identifier without a mark
    n = len(word) - K + 1
    acc, plain = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(K):
        acc = acc * np.uint64(0xD1342543DE82EF95) + unit[j : j + n]
        plain &= prose[j : j + n]
    of = row[word]
    ok = (of[:n] == of[K - 1 :]) & ~plain  # runs of words are prose
    key = distinct((of[:n][ok].astype(np.uint64) << np.uint64(40)) | (mix64(acc[ok]) & _MASK))
    bounds = np.searchsorted(key >> np.uint64(40), np.arange(rows_n + 1, dtype=np.uint64))
    key &= _MASK
    return [key[bounds[i] : bounds[i + 1]] for i in range(rows_n)]


def alike_windows(window: np.ndarray, shingle: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which windows have another of the same row whose set of shingles reaches the similarity.

    ``window`` and ``shingle`` are the occurrences, ``row`` the row of each window.  Windows of equal sets are
    one; neighbours in a MinHash bucket, and each with the first of it, are verified on whole sets.
    """
    out = np.zeros(len(row), bool)
    key = distinct((window.astype(np.uint64) << np.uint64(40)) | shingle)
    of, key = (key >> np.uint64(40)).astype(np.int64), key & _MASK
    some, start = np.unique(of, return_index=True)
    if len(some) < 2:
        return out
    size = np.diff(np.concatenate((start, [len(key)])))
    print_ = np.add.reduceat(mix64(key), start)
    # equal sets of a row
    order = np.lexsort((size, print_, row[some]))
    r, p, z = row[some][order], print_[order], size[order]
    new = np.concatenate(([True], (r[1:] != r[:-1]) | (p[1:] != p[:-1]) | (z[1:] != z[:-1])))
    group = np.empty(len(some), np.int64)
    group[order] = np.cumsum(new) - 1
    kin = np.bincount(group) > 1
    lead = np.empty(len(kin), np.int64)  # a window that stands for the group
    lead[group[order]] = order
    # others of the row: only rows with several groups
    per = np.bincount(row[some][lead], minlength=int(row.max()) + 1)
    lead = lead[per[row[some][lead]] > 1]
    if len(lead):
        at = np.repeat(start[lead], size[lead]) + np.arange(size[lead].sum()) - np.repeat(np.cumsum(size[lead]) - size[lead], size[lead])
        sig = signatures(key[at], size[lead], INNER_BANDS, INNER_ROWS)
        n, b = sig.shape
        who = np.repeat(np.arange(n), b)
        flat = mix64(sig.ravel() + row[some][lead][who].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(flat, kind="stable")
        flat, who = flat[order], who[order]
        fresh = np.concatenate(([True], flat[1:] != flat[:-1]))
        head = who[np.maximum.accumulate(np.where(fresh, np.arange(len(who)), 0))]
        pairs = np.concatenate((np.stack((who[:-1], who[1:]), 1)[~fresh[1:]], np.stack((head, who), 1)[~fresh]))
        pairs = np.sort(pairs[row[some][lead][pairs[:, 0]] == row[some][lead][pairs[:, 1]]], axis=1)
        pairs = pairs[pairs[:, 0] < pairs[:, 1]]
        if len(pairs):
            pairs = np.unique(pairs, axis=0)
            first = np.cumsum(size[lead]) - size[lead]
            for lo in range(0, len(pairs), 50_000):
                part = pairs[lo : lo + 50_000]
                both = common(key[at], first, size[lead], part)
                good = part[both * DEN >= NUM * (size[lead][part].sum(axis=1) - both)]
                kin[group[lead[good.ravel()]]] = True
    out[some] = kin[group]
    return out


def common(keys: np.ndarray, first: np.ndarray, size: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Number of shared members of each pair of sets; sets lie in ``keys`` from ``first`` on."""
    ends = pairs.ravel()
    n = size[ends]
    at = np.repeat(first[ends], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    both = np.sort((np.repeat(np.arange(len(pairs)), n.reshape(-1, 2).sum(axis=1)).astype(np.uint64) << np.uint64(40)) | keys[at])
    return np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(40)).astype(np.int64), minlength=len(pairs))


SKETCH = 256  # bits of a sketch: one of each of as many MinHashes
FAR = 47  # bits that sketches of sets at the least similarity differ in at most, but for three pairs in a million
_SEEDS = mix64(np.arange(1, BANDS * ROWS + SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(keys: np.ndarray, sizes: np.ndarray, n_bands: int, n_rows: int, at_once: int = 1 << 16) -> np.ndarray:
    """Band hashes (a row per set) of the MinHash signatures of sets that follow each other in ``keys``."""
    mixed, seeds = mix64(keys), _SEEDS[: n_bands * n_rows]
    ends = np.cumsum(sizes)
    out = np.empty((len(sizes), n_bands), np.uint64)
    lo = 0
    while lo < len(sizes):
        base = ends[lo] - sizes[lo]
        hi = max(int(np.searchsorted(ends, base + at_once, "right")), lo + 1)
        starts = ends[lo:hi] - sizes[lo:hi] - base
        part = mixed[base : ends[hi - 1]]
        least = np.stack([np.minimum.reduceat(part * s, starts) for s in seeds], 1).reshape(hi - lo, n_bands, n_rows)
        acc = np.broadcast_to(np.arange(n_bands, dtype=np.uint64), (hi - lo, n_bands))
        for j in range(n_rows):
            acc = mix64(acc * np.uint64(0xD1342543DE82EF95) + least[:, :, j])
        out[lo:hi] = acc
        lo = hi
    return out


# ------------------------------------------------------------------ the operator

_LINE = "struct<says:string,form:binary>"
_FACTS = f"doc long, version long, project string, path_says string, head_says string, compact boolean, lock boolean, blob boolean, kind string, carries float, literals float, inner float, n_tokens long, frame_size int, rep binary, bands array<long>, sketch binary, n_shingles int, lines array<{_LINE}>"
_FACT_NAMES = [x.split(" ")[0] for x in _FACTS.split(", ")]


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.float32(), pa.float32(), pa.float32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.list_(pa.struct([("says", pa.string()), ("form", pa.binary())]))]
    for b in batches:
        offsets, raw = text_buffers(b.column("text"))
        ids, versions, paths, langs = (b.column(c).to_pylist() for c in ("doc", "version", "path", "lang"))
        for lo, hi in row_chunks(offsets):
            part = raw[offsets[lo] : offsets[hi]]
            at = offsets[lo : hi + 1] - offsets[lo]
            f = frames(part, at)
            # bytes in lines of 200 or more, and blanks, per row
            cuts = np.union1d(np.flatnonzero(part == 10) + 1, at)
            length = np.diff(cuts)
            line_row = np.searchsorted(at, cuts[:-1], "right") - 1
            long = np.bincount(line_row, weights=np.where(length > 200, length, 0), minlength=hi - lo)
            total = np.concatenate(([0], np.cumsum((part == 32) | (part == 9))))
            blank = total[at[1:]] - total[at[:-1]]
            sizes = np.array([len(x) for x in f.sets], np.int64)
            some = np.flatnonzero(sizes)
            place = np.cumsum(sizes > 0) - 1
            keys = np.concatenate(f.sets)
            banded = signatures(keys, sizes[some], BANDS, ROWS).astype(np.int64).tolist() if len(some) else []
            drawn = sketches(keys, sizes[some]) if len(some) else []
            texts = b.column("text").slice(lo, hi - lo).to_pylist()
            rows = []
            for i, text in enumerate(texts):
                path = paths[lo + i]
                owner, repo = own_project(path)
                size = int(at[i + 1] - at[i])
                text = text or ""
                head = head_lines(text)
                says = statements(head, owner, repo)
                stated = "kept" if "kept" in says else next((s for s in says if s), "")
                lines = [{"says": s, "form": x} for s, x in zip(says, map(line_form, head), strict=True) if x]
                own = (_digest(f.sets[i].tobytes()), banded[place[i]], drawn[place[i]]) if sizes[i] else (None, None, None)
                compact = size >= 200 and long[i] >= 0.6 * size and blank[i] <= 0.1 * size
                rows.append((
                    ids[lo + i], versions[lo + i], f"{owner}/{repo}" if owner else None, said_by_path(path), stated, bool(compact), is_lock(text), size >= 200 and bool(f.coded[i] >= BLOB * size), kind_of(path, langs[lo + i], text),
                    float(f.carries[i]), float(f.literals[i]), float(f.inner[i]), int(f.n_tokens[i]), int(f.size[i]), *own, int(sizes[i]), lines,
                ))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_FACT_NAMES)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def sketches(keys: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The sketch of each of the sets that follow each other in ``keys``."""
    mixed, starts = mix64(keys), np.cumsum(sizes) - sizes
    bits = np.empty((len(sizes), SKETCH), bool)
    for j, seed in enumerate(_SEEDS[BANDS * ROWS :]):
        bits[:, j] = np.minimum.reduceat(mixed * seed, starts) >> np.uint64(20) & np.uint64(1)
    return [x.tobytes() for x in np.packbits(bits, axis=1)]


def _places(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rest: tuple[str, ...]) -> Iterator[list[tuple]]:
    """The rows of each place (equal ``keys``), which follow each other; places of one row are left out."""
    place: list[tuple] = []
    for b in batches:
        for m in zip(*(b.column(k).to_pylist() for k in (*keys, *rest)), strict=True):
            if place and place[0][: len(keys)] != m[: len(keys)]:
                if len(place) > 1:
                    yield place
                place = []
            place.append(m)
    if len(place) > 1:
        yield place


def _stars(found: Iterator[tuple[list, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Links of members to the first of their component."""
    a: list = []
    c: list = []
    for ids, of in found:
        out = np.flatnonzero(of != np.arange(len(of)))
        a += [ids[i] for i in out]
        c += [ids[of[i]] for i in out]
        if len(a) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])
            a, c = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])


def near(sketch: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first member of each member's component, links being pairs whose sketches are near."""
    of = np.full(len(size), -1)
    left = np.arange(len(size))
    while len(left):
        root, left = left[0], left[1:]
        of[root] = root
        queue = np.array([root])
        while len(queue) and len(left):
            some, queue = queue[:64], queue[64:]
            ok = np.bitwise_count(sketch[some][:, None, :] ^ sketch[left][None, :, :]).sum(axis=2, dtype=np.int32) <= FAR
            ok &= (size[some][:, None] * DEN >= size[left][None, :] * NUM) & (size[left][None, :] * DEN >= size[some][:, None] * NUM)
            hit = left[ok.any(axis=0)]
            of[hit] = root
            queue = np.concatenate((queue, hit))
            left = left[of[left] < 0]
    return of


def _near_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places = _places(batches, ("bucket", "meet"), ("doc", "sketch", "n_shingles"))
    yield from _stars(([m[2] for m in p], near(np.frombuffer(b"".join(m[3] for m in p), np.uint64).reshape(len(p), -1), np.array([m[4] for m in p]))) for p in places)


def _components(sets: list[np.ndarray]) -> np.ndarray:
    """The first member of each member's component, links being all pairs that reach the similarity.

    A search from each member in turn compares it with those not reached yet, so a bucket of one family costs one
    comparison per member, and no link between components is left out.
    """
    sizes = np.array([len(x) for x in sets])
    at = np.unique(np.concatenate(sets), return_inverse=True)[1]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    of = np.full(len(sets), -1)
    has = np.zeros(int(at.max()) + 1, bool)
    left = np.arange(len(sets))  # not reached
    while len(left):
        root, left = left[0], left[1:]
        of[root] = root
        queue = [int(root)]
        while queue and len(left):
            x = queue.pop()
            mine = at[bounds[x] : bounds[x + 1]]
            # only sizes that can reach the similarity
            near = (sizes[left] * DEN >= sizes[x] * NUM) & (sizes[x] * DEN >= sizes[left] * NUM)
            cand = left[near]
            if not len(cand):
                continue
            has[mine] = True
            n = sizes[cand]
            first = np.cumsum(n) - n
            both = np.add.reduceat(has[at[np.repeat(bounds[cand] - first, n) + np.arange(n.sum())]].astype(np.int32), first)
            has[mine] = False
            good = cand[both * DEN >= NUM * (n + sizes[x] - both)]
            of[good] = root
            queue += good.tolist()
            left = left[of[left] < 0]
    return of


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places = _places(batches, ("coarse", "meet"), ("doc", "shingles"))
    yield from _stars(([m[2] for m in p], _components([np.frombuffer(m[3], np.uint64) for m in p])) for p in places)


def _meeting(rows: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``meet``, those of a place together: frequent keys in blocks of which each two meet."""
    parts = F.ceil(F.col("n") / F.lit(PER_BLOCK)).cast("int").alias("parts")
    met = salted_join(rows, sizes.select(key, "n", parts), key, "n").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    met = met.withColumn("meet", F.expr("explode(transform(sequence(0, parts - 1), j -> CAST(least(block, j) AS BIGINT) * parts + greatest(block, j)))"))
    return met.drop("parts", "block")


def _sets(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc, rep, shingles`` of the texts of ``df`` (``doc, text``) whose ids are in ``wanted`` (``doc``), and a few more."""
    found, bits = bitmap(wanted, "doc")
    shared = df.sparkSession.sparkContext.broadcast(found)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(shared.value, np.int64)
        for b in batches:
            slot = b.column("slot").to_numpy()
            take = pa.array(np.flatnonzero((marks[slot >> 6] >> (slot & 63)) & 1))
            if not len(take):
                continue
            ids, text = b.column("doc").take(take), b.column("text").take(take)
            offsets, raw = text_buffers(text)
            for lo, hi in row_chunks(offsets):
                kind, row, _ = masked_tokens(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                found = [x.tobytes() for x in word_shingles(kind, row, hi - lo)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array([_digest(x) for x in found], pa.binary()), pa.array(found, pa.binary())], names=["doc", "rep", "shingles"])

    return with_slot(df, bits).mapInArrow(work, "doc long, rep binary, shingles binary")


def families(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """``doc, home, family`` of ``facts`` (``doc, home, rep, bands, sketch, n_shingles``) that have shingles.

    ``rep`` is the digest of the set, and the least id with one stands for all.  In each bucket, members whose
    sketches are near are linked; components of these links are the coarse families, in which all pairs are
    verified on whole sets, read once more from ``texts`` (``doc, text``).  Frequent buckets and coarse families
    are cut into blocks of which each two meet in a place of their own.
    """
    some = facts.where("rep IS NOT NULL")
    first = F.min_by(F.struct("bands", "sketch", "n_shingles"), "doc").alias("x")
    reps = durable(some.groupBy("rep").agg(F.min("doc").alias("doc"), F.count("*").alias("n"), first).select("rep", "doc", "n", "x.*"), "origin-sets")
    member = reps.select("doc", F.explode("bands").alias("bucket"))
    many = durable(member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "origin-buckets")
    met = _meeting(member, many, "bucket").join(reps.select("doc", "sketch", "n_shingles"), "doc")
    alike = durable(met.repartition("bucket", "meet").sortWithinPartitions("bucket", "meet").mapInArrow(_near_links, "a long, b long").distinct(), "origin-near")
    coarse = connected_components(alike, "a", "b").select(F.col("node").alias("doc"), F.col("component").alias("coarse"))
    wanted = durable(coarse.join(reps.select("doc", "rep"), "doc"), "origin-coarse")
    # texts delivered twice, and ids whose later text is another, fall out here
    sets = _sets(texts, wanted).join(wanted, ["doc", "rep"]).groupBy("doc").agg(F.first(F.struct("coarse", "shingles")).alias("x")).select("doc", "x.*")
    met = _meeting(durable(sets, "origin-shingles"), wanted.groupBy("coarse").agg(F.count("*").alias("n")), "coarse")
    links = durable(met.repartition("coarse", "meet").sortWithinPartitions("coarse", "meet").mapInArrow(_links, "a long, b long").distinct(), "origin-links")
    comp = connected_components(links, "a", "b")
    named = reps.select("rep", "n", "doc").join(comp.select(F.col("node").alias("doc"), "component"), "doc", "left").select("rep", F.coalesce("component", "doc").alias("family"), "n")
    return salted_join(some.select("doc", "home", "rep"), named, "rep", "n").drop("rep")


def origins(df: DataFrame, id_col: str, path_col: str, text_col: str, lang_col: str, version_col: str | None = None) -> DataFrame:
    """One row per id: ``doc, origin, family, family_files, family_projects, own_files`` and the facts behind them.

    ``origin`` is ``generated``, ``minified``, ``vendored``, ``data`` or null (hand-written).  ``family`` is the least
    id of the files whose whole text is alike, ``own_files`` how many of them lie in the file's repository.
    """
    version = F.unix_micros(F.col(version_col).cast("timestamp")) if version_col else F.lit(0).cast("long")
    src = df.select(F.col(id_col).cast("long").alias("doc"), version.alias("version"), F.col(path_col).alias("path"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("doc is not null")
    cols = _FACT_NAMES[2:]
    facts = src.mapInArrow(_facts, _FACTS).groupBy("doc").agg(F.max_by(F.struct(*cols), F.struct("version", "n_tokens", "head_says")).alias("x")).select("doc", *[f"x.{c}" for c in cols])
    facts = durable(facts, "origin-facts")
    home = F.coalesce("project", F.concat(F.lit("\0"), F.col("doc").cast("string"))).alias("home")
    of = durable(families(facts.select("doc", home, "rep", "bands", "sketch", "n_shingles"), src.select("doc", "text")), "origin-families")
    per = durable(of.groupBy("family", "home").agg(F.count("*").alias("own_files")), "origin-homes")
    # only families of several files; the others are told by their absence
    stats = per.groupBy("family").agg(F.sum("own_files").alias("family_files"), F.count("*").alias("family_projects")).where("family_files > 1")
    texts = salted_join(of, stats.withColumn("w", F.col("family_files")), "family", "w")
    own = per.where("own_files > 1").select(F.struct("family", "home").alias("place"), "own_files", F.col("own_files").alias("w"))
    texts = salted_join(texts.withColumn("place", F.struct("family", "home")), own, "place", "w", "left").select("doc", "family", "family_files", "family_projects", F.coalesce("own_files", F.lit(1)).alias("own_files"))
    # lines of one form; a file counts once
    lines = facts.select("doc", home, F.explode("lines").alias("u")).groupBy("u.form", "doc").agg(F.max("home").alias("home"), F.max("u.says").alias("says"))
    told = lines.groupBy("form").agg(F.count("*").alias("files"), F.min("home").alias("lo"), F.max("home").alias("hi"), F.count_if(F.expr("says IN ('generated', 'vendored')")).alias("w")).where("w > 0 AND files > 1")
    told = salted_join(lines.where("says IN ('generated', 'vendored')"), told.select("form", "files", (F.col("lo") < F.col("hi")).alias("apart"), "w"), "form", "w")
    told = told.groupBy("doc").agg(F.max(F.when(F.col("says") == "generated", F.col("files"))).alias("notice_files"), F.max((F.col("says") == "vendored") & F.col("apart")).alias("notice_apart"))
    out = facts.drop("rep", "bands", "sketch", "n_shingles", "lines").join(texts, "doc", "left").join(told, "doc", "left")
    one = lambda c: F.coalesce(F.col(c), F.lit(1)).alias(c)
    out = out.select(
        "doc", F.coalesce("family", "doc").alias("family"), one("family_files"), one("family_projects"), one("own_files"), one("notice_files"), F.coalesce("notice_apart", F.lit(False)).alias("notice_apart"),
        *[c for c in cols if c not in ("project", "rep", "bands", "sketch", "n_shingles", "lines", "frame_size")], F.when((F.col("frame_size") >= 3) & (F.col("carries") >= 0.3), F.col("frame_size")).otherwise(0).alias("frame_size"),
    )
    return out.select("doc", origin_of().alias("origin"), *[c for c in out.columns if c != "doc"])


def origin_of() -> Column:
    """The origin by a row's families and the exact check of what they indicate."""
    windows = F.col("inner") >= INNER
    copied = F.col("family_files") >= 2
    # what the families indicate
    within = (F.col("own_files") >= 2) | windows | copied
    across = F.col("family_projects") >= 2
    literal_only = (F.col("literals") >= 0.295) & (copied | windows)
    # what path, head and text show
    code = (F.col("kind") == "code") & (((F.col("carries") >= ALONE) & windows) | ((F.col("carries") >= CARRIES) & copied))
    # hand-written marks and statements recur as well, but not in so few forms
    marks = (F.col("kind") == "marks") & (F.col("carries") >= 0.9) & F.col("frame_size").between(1, TABLE) & (copied | literal_only)
    mechanical = (F.col("n_tokens") >= 60) & (code | marks)
    return (
        F.when((F.col("lock") | F.col("blob")) & (copied | windows), "data")
        .when((F.col("path_says") == "vendored") & across, "vendored")
        .when((F.col("head_says") == "vendored") & (across | F.col("notice_apart")), "vendored")
        .when((F.col("head_says") == "generated") & (within | (F.col("notice_files") >= 2)), "generated")
        .when(F.col("compact") & within, "minified")
        .when(mechanical, F.when(literal_only, "data").otherwise("generated"))
        .when((F.col("path_says") == "generated") & (F.col("n_tokens") > 0) & (F.col("head_says") != "kept") & within, "generated")
    )
