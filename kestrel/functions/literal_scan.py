"""One pass over a text for many literals at once (C1-C4, C6, C7 over long texts).

An Aho-Corasick automaton reads the lower-cased text once and says which of the rules' literals occur in it.  Keyword rules
are answered by that alone.  A pattern or exemplar is evaluated, by the same column expressions as for short messages, only
for texts that hold every literal it cannot match without; so results are those of the plain rules.

Texts go through in Arrow batches; without the automaton's package the literals are looked up one by one.
"""
from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

SHORTEST = 3  # shorter literals stand in almost every text: they are not looked up and count as found
WORD = 62
# Characters that a case-insensitive pattern takes for an ASCII letter although their lower case is another: such a text
# is a candidate of every pattern.
FOLDING = "ſıİK"
THREE_DIGITS = "\x00digits"  # a place of its own: three ASCII digits in a row


def runs(pattern: str) -> list[str]:
    """The literals that every match of a pattern of plain words and groups of alternatives holds."""
    return [r for r in re.split(r"\([^)]*\)\??", pattern) if r]


class Scan:
    """The literals found in a text column, as a column; ``has`` asks for one of them."""

    def __init__(self, text: Column, literals: Sequence[str]):
        self.place = {w: i for i, w in enumerate(dict.fromkeys([THREE_DIGITS, *(w for w in literals if len(w) >= SHORTEST)]))}
        self.mask = F.pandas_udf(_finder(list(self.place)), ArrayType(LongType()))(text)

    def has(self, mask: Column, literal: str) -> Column:
        if literal != THREE_DIGITS and len(literal) < SHORTEST:
            return F.lit(True)
        at = self.place[literal]
        return F.get(mask, F.lit(at // WORD)).bitwiseAND(F.lit(1 << at % WORD)) != 0

    def may_match(self, mask: Column, literals: Sequence[str]) -> Column:
        """Whether a case-insensitive pattern that cannot match without ``literals`` has to be tried."""
        out = F.lit(True)
        for w in literals:
            out = out & self.has(mask, w)
        return out | (F.get(mask, F.lit(len(self.place) // WORD + 1)) != 0)


def found_in(text: str, literals: Sequence[str], automaton) -> int:
    """Bits of the literals in one text."""
    low = text.lower()
    bits = 0
    if automaton is None:
        for i, w in enumerate(literals[1:], 1):
            if w in low:
                bits |= 1 << i
    else:
        for _, i in automaton.iter(low):
            bits |= 1 << i
    if re.search("[0-9]{3}", low):
        bits |= 1
    if any(c in text for c in FOLDING):
        bits |= _FOLDED
    return bits


_FOLDED = 1 << 200  # above all literals: the text has a character of FOLDING


def automaton_of(literals: Sequence[str]):
    try:
        import ahocorasick
    except ImportError:
        return None
    out = ahocorasick.Automaton()
    for i, w in enumerate(literals):
        if i:
            out.add_word(w, i)
    out.make_automaton()
    return out


def _finder(literals: list[str]):
    words = len(literals) // WORD + 1
    low = (1 << WORD) - 1
    made: list = []

    def find(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(automaton_of(literals))
        out = []
        for t in texts:
            bits = found_in(t, literals, made[0]) if t is not None else 0
            folded = bits >= _FOLDED
            # one word more: whether the text has a character of FOLDING
            out.append([(bits >> WORD * k) & low for k in range(words)] + [int(folded)])
        return pd.Series(out)

    find.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return find
