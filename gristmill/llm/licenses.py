"""Operator 4. License scan: ordered signature rules behind a keyword prefilter.

Every text is searched once for the keywords of all rules (an Aho-Corasick automaton over the lower-cased text with white space
made single). Only rules of which a keyword occurs run their regex, over the whole text. Overlaps are resolved by priority: detections are
taken by priority, then length, then rule order, and one whose interval lies within a detection taken before is
suppressed; detections that overlap in part stay both. No exchange: each document is decided in its own task.

Defined cases: NULL and empty texts have no detection; equal intervals go to the higher priority, then the earlier rule; repeated rows are each
reported; a NULL doc_id is reported as NULL; other columns take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import re
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from gristmill.llm.common import small_batches
from gristmill.llm.license_rules import rules, spelled

SCHEMA = "doc_id bigint, license string, rule string, priority int, start int, stop int, matched string"
_SPACE = re.compile(r"\s+")
_RUN = re.compile(r"\s{2,}")
#: White space that is not one space or line feed alone.
_WIDE = re.compile(r"\s\s|[^\S \n]")
#: Letters that a case-insensitive pattern takes for ASCII ones and lower() leaves or makes longer.
_ALIKE = (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"))


class Scanner:
    def __init__(self, table: list[tuple[str, str, int, tuple[str, ...], str]]):
        import ahocorasick

        self.rules = [(r, lic, p, k, re.compile(x, re.IGNORECASE)) for r, lic, p, k, x in table]
        by_word: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            for k in r[3]:
                by_word.setdefault(k, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for k, v in by_word.items():
            self.automaton.add_word(k, v)
        self.automaton.make_automaton()

    def scan(self, text: str) -> list[tuple[str, str, int, int, int]]:
        """(license, rule, priority, start, stop) of the detections that stay, by start; offsets in ``text``."""
        flat = _SPACE.sub(" ", text) if _WIDE.search(text) else text.replace("\n", " ")
        low = flat
        if not flat.isascii():
            for c, plain in _ALIKE:
                low = low.replace(c, plain)
        low = low.lower()
        gated = sorted({i for _, v in self.automaton.iter(low) for i in v})
        hits = []
        for i in gated:
            rule, lic, priority, _, pattern = self.rules[i]
            for m in pattern.finditer(flat):
                a, z = m.span()
                if z > a:
                    # the license of a rule with a group is read off the match
                    hits.append((-priority, a - z, i, a, z, lic.format(**{k: spelled(v) for k, v in m.groupdict().items()}) if "{" in lic else lic))
        # Who lies within a suppressed detection lies within its suppressor too, so a detection goes if any one of higher rank
        # contains it. By start, the longest first, containers come before what they contain: one pass with the furthest
        # stop of each priority decides.
        kept: list[tuple[int, int, int, str]] = []
        furthest: dict[int, int] = {}
        for p, _, i, a, z, lic in sorted(hits, key=lambda h: (h[3], -h[4], h)):
            if not any(q <= p and stop >= z for q, stop in furthest.items()):
                kept.append((a, z, i, lic))
            furthest[p] = max(z, furthest.get(p, 0))
        if not kept:
            return []
        at = _offsets(text) if len(flat) != len(text) else int
        out = [(lic, self.rules[i][0], self.rules[i][2], at(a), at(z - 1) + 1) for a, z, i, lic in kept]
        return sorted(out, key=lambda r: (r[3], -r[4], r[1]))


def _offsets(text: str) -> Callable[[int], int]:
    """From a place in the text with single spaces to the place in the text."""
    ends, shifts, shift = [-1], [0], 0
    for m in _RUN.finditer(text):
        shift += m.end() - m.start() - 1
        ends.append(m.end() - shift)
        shifts.append(shift)
    return lambda a: a + shifts[bisect.bisect_right(ends, a) - 1]


def scanner() -> Scanner:
    """The worker process's scanner."""
    state = sys.modules.setdefault("_gristmill_worker", types.ModuleType("_gristmill_worker"))
    if "scanner" not in state.__dict__:
        state.scanner = Scanner(rules())
    return state.scanner


def detect(docs: DataFrame) -> DataFrame:
    """One row for each detection that stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner()
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        for b in batches:
            rows = []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                text = t.as_py()
                if text:
                    rows.extend((i, *d, text[d[3] : d[4]]) for d in s.scan(text))
            c = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], names)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
