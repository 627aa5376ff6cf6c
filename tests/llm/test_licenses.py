import random

from ranklake.llm import licenses as L

PARTS = ["MIT License", "Licensed under the Apache License, Version 2.0.", "GNU General\nPublic License, version 3", "GPLv2+", "CC BY-NC 4.0", "Copyright (c) 2019", "spdx-license-identifier: GPL-2.0+", "all rights reserved", "BSD  license", "nothing", "permit", "https://opensource.org/licenses/MIT", "Released under the MIT License."]


def test_there_are_hundreds_and_each_keyword_is_in_its_gate():
    rules = L.parse(L.RULES)
    assert len(rules) > 240
    assert [r.priority for r in rules] == sorted(r.priority for r in rules)


def test_equals_all_rules_without_gates():
    r, s = random.Random(6), L.Scanner()
    for _ in range(60):
        text = " ".join(r.choice(PARTS) for _ in range(r.randint(0, 12)))
        every = [L.Found(m.start(), m.end(), rule) for rule in s.rules for m in rule.pattern.finditer(text)]
        every.sort(key=lambda x: (x.rule.priority, x.start - x.end, x.start, x.rule.rule_id))
        want = []
        for x in every:
            spans = [(set(range(x.start, x.end)), set(range(y.start, y.end))) for y in want]
            if not any(a <= b or b <= a or (x.rule.priority == L.GENERIC and a & b) for a, b in spans):
                want.append(x)
        assert s.scan(text) == sorted(want, key=lambda x: (x.start, x.end))


def test_known_lines():
    one = lambda t: [(x.rule.license, t[x.start : x.end]) for x in L.scanner().scan(t)]
    assert one("Released under the MIT License.") == [("MIT", "MIT License")]
    assert one("Licensed under the Apache License, Version 2.0.") == [("Apache-2.0", "Apache License, Version 2.0")]
    assert one("This work is licensed under the GNU General Public License, version 3.") == [("GPL-3.0", "GNU General Public License, version 3")]
    assert one("Licensed under CC BY-NC 4.0.") == [("CC-BY-NC-4.0", "CC BY-NC 4.0")]
    assert one("permit the mitten") == []


def test_odd_rows(spark):
    rows = [(1, "MIT License", 1), (1, "MIT License", 1), (None, "İ MIT License", 2), (2, None, 3), (3, "", 4), (4, "a " * 100_000 + "MIT License", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license int")
    got = [(r.doc_id, r.start, r.end, r.license, r.matched) for r in L.scan(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 11, "MIT", "MIT License")] * 2 + [(None, 2, 13, "MIT", "MIT License"), (4, 200_000, 200_011, "MIT", "MIT License")], key=str)
    assert L.scan(df.limit(0)).count() == 0


SPELLINGS = ["MIT licence", "MIT-licenced", "mit-licence", "Expat Licence", "X11 licence", "ISC licence", "zlib licence", "zlib/libpng licence", "Ruby's licence", "Vim licence", "curl licence", "ICU Licence", "JSON licence", "Apache Licence", "BSD licence",
             "BSD-style licence", "see licence", "see the licence file", "Open RAIL", "BigScience Open\nRAIL-M", "open rail++-m licence", "GNU General Public Licence", "PostgreSQL licence", "end user licence agreement", "MİT Lıcenſe", "Apache\u00a0Licence", "three clause BSD licence"]


def test_every_spelling_passes_the_filter():
    s = L.Scanner()
    for text in SPELLINGS:
        every = [L.Found(m.start(), m.end(), rule) for rule in s.rules for m in rule.pattern.finditer(text)]
        assert every and s.scan(text) == L.settle(every), text


def test_required():
    of = lambda p: L.required(L.parse(f"1 | x | x | {p}")[0].pattern)
    assert of(r"\bmit licen[cs]e\b") == {"licen"}
    assert of(r"open ?rail(-m)?") == {"rail"}
    assert of(r"(old bsd|simplified)( licen[cs]e)?") == {"bsd", "simplified"}
    assert of(r"(ab)?[cd]") == set() and of(r"a(b|)(?!cde)") == {"a"}
    s = L.Scanner()
    assert not s.always
