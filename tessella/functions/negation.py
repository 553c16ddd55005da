"""Finding the terms that a text states and does not negate.

All terms are put into one automaton, which gives every occurrence of any of them
in a single pass over a text; only around an occurrence is the text looked at
more closely.  An occurrence counts unless a negation is attached to its word,
stands before it in its clause, or follows it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.shipping import ship

# The negation vocabulary and the clause boundaries in English
# and Chinese, and how many characters around an occurrence are looked at.
PRECEDING = (
    r"(?:\bno(?:\s+(?:evidence|signs?)\s+of)?\b|\bnot\b|\bwithout\b|\babsence\s+of\b|\black(?:ing)?\s+of\b|\bfree\s+of\b|"
    r"\bnegative\s+for\b|\bneither\b|\bnon(?:[-‐‑‒–—]\s*|\s+)|(?:未见|未发现|没有|缺乏|不存在|不支持))"
)
ATTACHED = r"(?:\bnon(?:[-‐‑‒–—]\s*)?|(?:非|无|未见|未发现|没有|缺乏|不存在|不支持))\Z"
FOLLOWING = (
    r"^\s*(?:[:=\-]\s*)?(?:(?:growth|pattern|activity|formation|invasion|expression|features?|finding)\b\s*){0,2}(?:[:=\-]\s*)?"
    r"(?:(?:is|are|was|were|appears?|remains?)\s+)?(?:absent|negative|lacking|not\s+(?:seen|observed|identified|present|evident|detected))\b|"
    r"^\s*性?\s*(?:(?:生长|结构|形成|活动|表达|征象|证据)\s*){0,2}(?:为|呈)?\s*(?:未见|未发现|不存在|缺如|阴性)"
)
BOUNDARY = (
    r"(?:[.!?;\n\r。！？；]|,\s*(?=(?:but|however|yet|whereas|although|while|with|showing|featuring)\b)|"
    r"，\s*(?=(?:但|但是|然而|不过|却|同时可见|并可见)))"
)
NOT_ONLY = r"\bnot\s+only\b"
ATTACHED_CHARS, CLAUSE_CHARS = 16, 96

_PRECEDING, _ATTACHED, _FOLLOWING, _BOUNDARY, _NOT_ONLY = (re.compile(p, re.IGNORECASE) for p in (PRECEDING, ATTACHED, FOLLOWING, BOUNDARY, NOT_ONLY))
#: What a word goes on with after an occurrence.
_WORD_AFTER = re.compile(r"[A-Za-z0-9_]*")
#: More than the longest word that a clause boundary looks ahead for.
_AHEAD = 16


def _clause_before(text: str, at: int) -> str:
    """What stands between the last clause boundary and ``at``, of the last ``CLAUSE_CHARS`` characters."""
    low = max(0, at - CLAUSE_CHARS)
    start = len(text[:low].rstrip())  # a boundary may begin at a comma before white space
    last = low
    for boundary in _BOUNDARY.finditer(text, max(0, start - 1), at):
        last = max(last, boundary.end())
    return text[last:at]


def _clause_after(text: str, at: int) -> str:
    """What stands between ``at`` and the next clause boundary, of the next ``CLAUSE_CHARS`` characters."""
    high = min(len(text), at + CLAUSE_CHARS)
    rest = text[high:]
    end = high + len(rest) - len(rest.lstrip()) if high < len(text) and text[high].isspace() else high
    boundary = _BOUNDARY.search(text, at, min(len(text), end + _AHEAD))
    return text[at : min(boundary.start(), high) if boundary else high]


def negated(text: str, start: int, end: int) -> bool:
    """Whether the occurrence from ``start`` to ``end`` of a case-folded text is negated."""
    if _ATTACHED.search(text[max(0, start - ATTACHED_CHARS) : start]):
        return True
    low = start
    while low > 0 and (text[low - 1].isascii() and (text[low - 1].isalnum() or text[low - 1] == "_")):
        low -= 1
    if _PRECEDING.search(_NOT_ONLY.sub("", _clause_before(text, low))):
        return True
    return bool(_FOLLOWING.search(_clause_after(text, _WORD_AFTER.match(text, end).end())))


class Terms:
    """An automaton over groups of terms."""

    def __init__(self, groups: Sequence[Sequence[str]]):
        owners: dict[str, list[int]] = {}
        for i, terms in enumerate(groups):
            for term in {t.casefold() for t in terms} - {""}:
                owners.setdefault(term, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for number, (term, of) in enumerate(owners.items()):
            self.automaton.add_word(term, (number, len(term), of))
        self.some = bool(owners)
        if self.some:
            self.automaton.make_automaton()

    def stated(self, text: str) -> list[int]:
        """Numbers of the groups of which ``text`` states a term, in order."""
        if not self.some:
            return []
        folded, done, free, found = text.casefold(), set(), {}, set()
        for last, (number, length, of) in self.automaton.iter(folded):
            start = last + 1 - length
            if number in done or start < free.get(number, 0):  # occurrences of one term do not overlap
                continue
            free[number] = last + 1
            if not negated(folded, start, last + 1):
                done.add(number)
                found.update(of)
        return sorted(found)


def matching_groups(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    """Numbers of the groups of which ``text`` states a term, from 0; none for null.  A text is passed once, however many terms there are."""
    if not groups:
        return F.array().cast("array<int>")
    ship()
    held = [list(g) for g in groups]

    @F.pandas_udf("array<int>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = Terms(held)
        for texts in batches:
            yield texts.map(lambda t: terms.stated(t) if t else [])

    return find(text)


def stated_terms(text: Column, terms: Sequence[str]) -> Column:
    """Numbers of the ``terms`` that ``text`` states at least once without negation, from 0."""
    return matching_groups(text, [[t] for t in terms])


def states(text: Column, term: str) -> Column:
    """Whether ``text`` states ``term`` at least once without negation; false for null and for an empty term."""
    return F.size(stated_terms(text, [term])) > 0
