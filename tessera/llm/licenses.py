"""License scans: template markup compiled to token automata.

A template is license wording with two kinds of markup:

* ``[[ ... ]]`` an optional region, which may nest;
* ``{{min,max}}`` a replaceable region of min to max arbitrary words
  (names, years, versions).

All other words are mandatory and must stand in the text exactly, in order,
after both sides went through the same word rule (lower-cased A-Z, words of
letters and digits). ``compile_template`` turns a template into a
nondeterministic automaton over words; ``Automata.find`` runs all of them over a
text in a single pass, with a start at every word, so the cost is linear in the
text whatever the number of starts. A text is only run where it holds the rarest
mandatory word sequence of some template, which is a plain substring test.

Defined results: null text is empty text; an empty text has no words, no places
and score 0; places that overlap all count; repeated rows are scanned alike, each
on its own; no row is dropped.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.rows import map_rows
from tessera.llm.textnorm import ALNUM_WORD, alnum_words
from tessera.session import table

# The phrases whose places count, with their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# License notices and licenses as templates, with their labels.
TEMPLATES = (
    ("mit", "[[this {{1,3}} is]] released under the mit license"),
    ("mit", "[[this {{1,3}} is]] licensed under the [[terms of the]] mit license"),
    ("mit", "spdx license identifier mit"),
    (
        "mit",
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the
        rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
        persons to whom the software is furnished to do so subject to the following conditions the above copyright
        notice and this permission notice [[including the next paragraph]] shall be included in all copies or
        substantial portions of the software""",
    ),
    ("apache-2", "licensed under the apache license version 2 [[0]] [[the license]]"),
    ("apache-2", "spdx license identifier apache 2 0"),
    ("apache-2", "released under [[the]] apache license [[version]] 2 0"),
    ("cc-by-nc", "licensed under [[a]] [[the]] cc by nc [[4 0]] [[3 0]]"),
    ("cc-by-nc", "[[this {{1,3}} is]] licensed under [[a]] [[the]] creative commons attribution non commercial [[{{1,2}}]] license"),
    ("cc-by-nc", "[[this {{1,3}} is]] licensed under [[a]] [[the]] creative commons attribution noncommercial {{0,2}} [[international]] license"),
    ("cc-by", "[[this {{1,3}} is]] licensed under [[a]] [[the]] creative commons attribution 4 0 [[international]] license"),
    ("cc-by-sa", "[[this {{1,3}} is]] licensed under [[a]] [[the]] creative commons attribution sharealike {{0,2}} [[international]] license"),
    ("gpl-2", "[[this {{1,3}} is]] licensed under the [[terms of the]] gnu general public license version 2 [[0]]"),
    ("gpl-3", "[[this {{1,3}} is]] licensed under the [[terms of the]] gnu general public license version 3 [[0]]"),
    ("gpl", "it under the terms of the gnu general public license as published by the free software foundation either version {{1,1}} of the license or [[at your option]] any later version"),
    ("lgpl-3", "[[this {{1,3}} is]] licensed under the [[terms of the]] gnu lesser general public license version 3 [[0]]"),
    ("agpl-3", "[[this {{1,3}} is]] licensed under the [[terms of the]] gnu affero general public license version 3 [[0]]"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (
        "bsd",
        """redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met [[1]] redistributions of source code must retain the above copyright notice this
        list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above
        copyright notice this list of conditions and the following disclaimer in the documentation and or other
        materials provided with the distribution""",
    ),
    (
        "bsd-3",
        """neither the name of {{1,12}} nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission""",
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc0", "to the extent possible under law {{1,12}} has waived all copyright and related or neighboring rights to"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

_MARK = re.compile(r"\[\[|\]\]|\{\{(\d+),(\d+)\}\}|[^\[\]{}]+")


@dataclass
class Automaton:
    """States are numbers; 0 starts, ``accept`` ends. ``after[s]`` is closed over skipped regions."""

    label: str
    words: list[dict[bytes, list[int]]] = field(default_factory=lambda: [{}])
    wild: list[list[int]] = field(default_factory=lambda: [[]])
    skip: list[list[int]] = field(default_factory=lambda: [[]])
    accept: int = 0
    anchor: bytes = b""

    def state(self) -> int:
        self.words.append({})
        self.wild.append([])
        self.skip.append([])
        return len(self.words) - 1

    def closure(self, states: list[int]) -> list[int]:
        seen, stack = set(), list(states)
        while stack:
            s = stack.pop()
            if s not in seen:
                seen.add(s)
                stack += self.skip[s]
        return sorted(seen)


def compile_template(label: str, template: str) -> Automaton:
    a = Automaton(label)
    now, opened, runs, run = 0, [], [], []
    for mark in _MARK.finditer(template):
        token = mark.group(0)
        if token == "[[":
            opened.append(now)
        elif token == "]]":
            end = a.state()
            a.skip[now].append(end)
            a.skip[opened.pop()].append(end)
            now = end
        elif mark.group(1):
            low, high = int(mark.group(1)), int(mark.group(2))
            ways = [now] if low == 0 else []
            for k in range(1, high + 1):
                nxt = a.state()
                a.wild[now].append(nxt)
                now = nxt
                if k >= low:
                    ways.append(now)
            end = a.state()
            for s in ways:
                a.skip[s].append(end)
            now = end
        else:
            for w in alnum_words(token):
                nxt = a.state()
                a.words[now].setdefault(w, []).append(nxt)
                now = nxt
                if not opened:
                    run.append(w)
            continue
        runs.append(run)
        run = []
    if opened:
        raise ValueError(f"optional region not closed in template of {label}")
    a.accept = now
    a.anchor = max((b" ".join(r) for r in [*runs, run]), key=len)
    if not a.anchor:
        raise ValueError(f"template of {label} has no mandatory wording")
    return a


class Automata:
    """All templates, run together over the words of a text."""

    def __init__(self, templates=TEMPLATES, phrases=BASE_PHRASES):
        self.automata = [compile_template(label, t) for label, t in templates]
        self.phrases = [(p.encode(), label, p.count(" ") + 1) for p, label in phrases.items()]

    def base(self, joined: bytes) -> list[tuple[int, str]]:
        """(first word, label) of every place of a base phrase in `` w w w ``."""
        found = []
        for phrase, label, _ in self.phrases:
            at = joined.find(b" " + phrase + b" ")
            word = last = 0
            while at >= 0:
                word += joined.count(b" ", last, at)
                last = at
                found.append((word, label))
                at = joined.find(b" " + phrase + b" ", at + 1)
        return sorted(found)

    def find(self, words: list[bytes], joined: bytes) -> list[tuple[str, int, int, int]]:
        """(label, first word, last word, mandatory and optional words matched) of every accepted range.

        Of the ranges of one automaton that start at the same word the longest is reported.
        """
        found = []
        for a in self.automata:
            if b" " + a.anchor + b" " in joined:
                found += ((a.label, *r) for r in run(a, words))
        return found


def run(a: Automaton, words: list[bytes]) -> list[tuple[int, int, int]]:
    """(first, last, literal words) of the ranges that the automaton accepts; the longest of a start.

    Where two starts lead to one state the earlier one goes on; a replaceable region at
    the start of a template takes words like any other.
    """
    best: dict[int, tuple[int, int, int]] = {}
    entry = a.closure([0])
    live: dict[int, tuple[int, int]] = {}
    for at, w in enumerate(words):
        nxt: dict[int, tuple[int, int]] = {}
        for s, (first, literal) in [*live.items(), *((s, (at, 0)) for s in entry if s not in live)]:
            for moved, gain in ((a.words[s].get(w, ()), 1), (a.wild[s], 0)):
                for t in a.closure(list(moved)) if moved else ():
                    key = (first, -literal - gain)
                    if t not in nxt or key < (nxt[t][0], -nxt[t][1]):
                        nxt[t] = (first, literal + gain)
        live = nxt
        if a.accept in live:
            first, literal = live[a.accept]
            best[first] = (first, at, literal)
    return sorted(best.values())


REPORT = "n_words long, base_places array<struct<word:long,label:string>>, matches array<struct<label:string,first_word:long,last_word:long,literal_words:long>>"


def scan_licenses(docs: DataFrame, text: str = "text", key: str = "doc_id", templates=TEMPLATES, phrases=BASE_PHRASES) -> DataFrame:
    """``key`` and the columns of REPORT for every row: places of base phrases and accepted templates."""

    def make():
        automata = Automata(templates, phrases)

        def work(ids, texts):
            for i, t in zip(ids, texts):
                words = alnum_words(t)
                joined = b" %s " % b" ".join(words)
                yield (
                    i,
                    len(words),
                    [{"word": w, "label": x} for w, x in automata.base(joined)],
                    [{"label": x, "first_word": f, "last_word": z, "literal_words": n} for x, f, z, n in automata.find(words, joined)],
                )

        return work

    return map_rows(docs, [key, text], f"{key} {docs.schema[key].dataType.simpleString()}, {REPORT}", make)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of ``scan_licenses``; score is the best share of literal words in an accepted range, 1 at a base place."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.selectExpr(
        "doc_id",
        "n_words",
        "cast(size(base_places) as long) AS n_base",
        "array_min(transform(base_places, p -> p.word)) AS first_word",
        "array_max(transform(base_places, p -> p.word)) AS last_word",
        "array_join(array_sort(array_distinct(transform(base_places, p -> p.label))), ',') AS base_labels",
        "array_join(array_sort(array_distinct(concat(transform(base_places, p -> p.label), transform(matches, m -> m.label)))), ',') AS labels",
        """CASE WHEN size(base_places) > 0 THEN 1D
           ELSE coalesce(array_max(transform(matches, m -> m.literal_words / (m.last_word - m.first_word + 1))), 0D) END AS score""",
        "cast(size(matches) as long) AS n_templates",
    )


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of ``op3_license_scan``, which SQL can express."""
    return op3_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


_PHRASES = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in BASE_PHRASES.items())
SQL = {
    "license_base_places": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM_WORD}') AS w FROM documents),
p(phrase, label, size) AS (VALUES {_PHRASES}),
f AS (SELECT doc_id, i - 1 AS pos, label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) JOIN p ON w[i] = split_part(phrase, ' ', 1) AND array_to_string(w[i:i + size - 1], ' ') = phrase),
g AS (SELECT doc_id, count(*) AS n, min(pos) AS a, max(pos) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word, coalesce(labels, '') AS base_labels
FROM d LEFT JOIN g USING (doc_id)"""
}
QUERIES = {"op3_license_scan": op3_license_scan, "license_base_places": license_base_places}
