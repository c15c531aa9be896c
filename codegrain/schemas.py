"""Feature layouts: which fields a token row has, and how many values each may take."""

from __future__ import annotations

from dataclasses import dataclass

#: Cardinalities of the fields shared by all layouts, in embedding order.
BASE = {"kind": 4, "len_bucket": 8, "first_char": 128, "last_char": 128, "hash1": 512, "hash2": 128, "trans_prev": 16, "trans_next": 16, "sym_prev": 32, "sym_next": 32}
GAPS = {"gap_prev": 4, "gap_next": 4, "indent": 8, "line_first": 32}
N_FLAGS = 8
WORD_HASHES = ("hash1", "hash2")


@dataclass(frozen=True)
class Layout:
    name: str
    fields: dict[str, int]
    drop_blanks: bool
    large: bool

    @property
    def offsets(self) -> dict[str, int]:
        """First embedding row of each field; flags follow the last field."""
        out, at = {}, 0
        for f, n in self.fields.items():
            out[f] = at
            at += n
        out["flags"] = at
        return out

    @property
    def rows(self) -> int:
        return sum(self.fields.values()) + N_FLAGS


#: The four layouts.
LAYOUTS = {
    "compact_v1": Layout("compact_v1", BASE, False, False),
    "compact_v2": Layout("compact_v2", BASE | {"hash1": 256} | GAPS | {"brace_depth": 4, "paren_depth": 4}, True, False),
    "large_v1": Layout("large_v1", BASE | {"hash1": 1024, "hash2": 256} | {"paren_depth": 8, "brace_depth": 8, "bracket_depth": 8, "line_pos": 8, "indent_bucket": 8, "quote_state": 4}, False, True),
    "large_v2": Layout("large_v2", BASE | {"hash1": 1024, "hash2": 256} | GAPS | {"brace_depth": 8, "paren_depth": 8, "bracket_depth": 8, "line_pos": 8, "quote_state": 4}, True, True),
}


def layout(family: str, version: int) -> Layout:
    """The layout of a model family ('compact' or 'large') and feature version; anything else raises."""
    try:
        return LAYOUTS[f"{family}_v{version}"]
    except KeyError:
        raise ValueError(f"unknown feature version {version} of {family}") from None
