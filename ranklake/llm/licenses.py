"""Licence scans by ordered signatures behind a filter of substrings; what overlaps is settled by priority and containment."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from re import _constants as C  # the parse tree of patterns
from re import _parser
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklake.llm.common import need
from ranklake.llm.license_rules import RULES

#: The priority of statements that name no licence.
GENERIC = 7


class Rule(NamedTuple):
    rule_id: int
    priority: int
    license: str
    keyword: str
    pattern: re.Pattern


class Found(NamedTuple):
    start: int
    end: int
    rule: Rule


def parse(rules: str) -> list[Rule]:
    """Rules by their lines; a rule's id is its place, from 1."""
    out = []
    for line in filter(None, map(str.strip, rules.splitlines())):
        priority, license_, keyword, pattern = (x.strip() for x in line.split("|", 3))
        out.append(Rule(len(out) + 1, int(priority), license_, keyword, re.compile(pattern.replace(" ?", r"\s?").replace(" ", r"\s+"), re.IGNORECASE | re.DOTALL)))
    return out


def required(pattern: re.Pattern) -> set[str]:
    """Substrings, in lower case, of which every match holds one; empty, if there are none such. The longest that there are."""

    def best(sets: list[set[str]]) -> set[str]:
        return max((x for x in reversed(sets) if x and min(map(len, x))), key=lambda x: min(map(len, x)), default=set())

    def walk(tree) -> set[str]:
        sets, run = [], ""

        def end() -> None:
            nonlocal run
            sets.append({run})
            run = ""

        def add(part) -> None:
            nonlocal run
            for op, value in part:
                if op is C.LITERAL:
                    run += chr(value).lower()
                elif op is C.SUBPATTERN:
                    add(value[3])
                elif op not in (C.AT, C.ASSERT, C.ASSERT_NOT):
                    end()
                    if op is C.BRANCH:
                        own = [walk(x) for x in value[1]]
                        sets.append(set().union(*own) if all(own) else set())
                    elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0]:
                        sets.append(walk(value[2]))

        add(tree)
        end()
        return best(sets)

    return walk(_parser.parse(pattern.pattern, pattern.flags))


def plain(text: str) -> str:
    """text in lower case, with an i, k or s for all that patterns take for one where case is ignored."""
    low = text.lower()
    return low if low.isascii() else low.replace("i\u0307", "i").replace("ı", "i").replace("ſ", "s")


class Scanner:
    def __init__(self, rules: str = RULES):
        self.rules = parse(rules)
        self.words = ahocorasick.Automaton()
        gates: dict[str, list[Rule]] = {}
        self.always: list[Rule] = []
        for r in self.rules:
            for word in (own := required(r.pattern)):
                gates.setdefault(word, []).append(r)
            if not own:
                self.always.append(r)
        for word, own in gates.items():
            self.words.add_word(word, own)
        self.words.make_automaton()

    def candidates(self, text: str) -> list[Rule]:
        """The rules that the text may match: it has a substring that their matches require."""
        met = {id(own): own for _, own in self.words.iter(plain(text))}
        return sorted({r.rule_id: r for own in [self.always, *met.values()] for r in own}.values())

    def scan(self, text: str) -> list[Found]:
        return settle([Found(m.start(), m.end(), r) for r in self.candidates(text) for m in r.pattern.finditer(text)])


def clash(x: Found, y: Found) -> bool:
    """Whether y, which stays, rules x out."""
    if x.rule.priority == GENERIC and x.start < y.end and y.start < x.end:
        return True
    return y.start <= x.start and x.end <= y.end or x.start <= y.start and y.end <= x.end


def settle(found: list[Found]) -> list[Found]:
    """Those that stay, by position. Lower priority numbers come first, then longer, earlier, lower rules; each that lies
    within one that stays, or holds one, goes. Partial overlaps both stay, but generic statements go even then."""
    stay: list[Found] = []
    for x in sorted(found, key=lambda x: (x.rule.priority, x.start - x.end, x.start, x.rule.rule_id)):
        if not any(clash(x, y) for y in _near(stay, x)):
            _insert(stay, x)
    return stay


def _near(stay: list[Found], x: Found) -> Iterator[Found]:
    """Those of stay that may hold x or lie in it. None of stay holds another, so their ends rise with their starts."""
    from bisect import bisect_left

    at = bisect_left(stay, x.start + 1, key=lambda y: y.start)
    if at:
        yield stay[at - 1]
    for y in stay[bisect_left(stay, x.start, key=lambda y: y.start) :]:
        if y.start > x.end:
            break
        yield y


def _insert(stay: list[Found], x: Found) -> None:
    from bisect import insort

    insort(stay, x, key=lambda y: (y.start, y.end))


@lru_cache(1)
def scanner() -> Scanner:
    return Scanner()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, rule_id, license, priority, matched): a row for each detection that stays.

    Positions count characters from 0, the end excluded. Null and empty texts have no detections; repeated rows have theirs
    each. Other columns are ignored. Lower case is for the filter alone, and moves no position.
    """
    need(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner()
        for b in it:
            at, out = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                for x in s.scan(text) if text else ():
                    at.append(i)
                    out.append((x.start, x.end, x.rule.rule_id, x.rule.license, x.rule.priority, text[x.start : x.end]))
            if out:
                types = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at)), *(pa.array(c, t) for c, t in zip(zip(*out), types))], ["doc_id", "start", "end", "rule_id", "license", "priority", "matched"])

    return rows.mapInArrow(f, f"doc_id {kind}, start int, end int, rule_id int, license string, priority int, matched string")
