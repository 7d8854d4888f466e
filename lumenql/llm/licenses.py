"""License scans by template-markup matching.

A template is the wording of a license notice. ``[ ... ]`` marks a part that
may be missing (parts nest), ``{n}`` a replaceable part of up to n words. All
other words are mandatory. A template is compiled into an automaton over words
and accepts a text in which it matches somewhere, mandatory wording exactly.

Besides, base phrases are counted: places where a phrase's words stand
consecutively.

Defined results: null and empty texts have no words, no places, no labels and
score 0; rows that repeat are scanned one by one; extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import python_batches, table

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Wordings of notices, as words.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license [version] 2 0",
    "bsd-3-clause": (
        "redistribution and use in source and binary forms with or without modification "
        "are permitted provided that the following conditions are met"
    ),
    "cc-by-nc": "[this work is] licensed under [a|the] [creative commons] cc by nc [{2} license]",
    "cc-by-sa": "[this work is] licensed under [a|the] [creative commons] cc by sa [{2} license]",
    "gpl-2.0": "[this {2} is] licensed under the [gnu] general public license [version|v] 2",
    "gpl-3.0": "[this {2} is] licensed under the [gnu] general public license [version|v] 3",
    "gpl-notice": (
        "under the terms of the gnu general public license as published by the free software "
        "foundation [either] version {2} of the license"
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with "
        "or without fee is hereby granted"
    ),
    "mit": "released under the [terms of the] mit license",
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of {5} "
        "and associated documentation files [the software] to deal in the software without restriction"
    ),
    "mpl-2.0": "subject to the terms of the mozilla public license v 2 0",
    "rights-notice": "copyright [c] {6} all rights reserved",
}

_GAPS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TO_WORDS = bytes.maketrans(_GAPS, b" " * len(_GAPS))
_MARKUP = re.compile(r"\[|\]|\||\{\d+\}|[^\s\[\]|{}]+")


def parse(template: str) -> list:
    """Nested parts: a word (str), ``{n}`` (int), or a list of alternatives of
    an optional part."""

    def sequence(at: int, inside: bool):
        options, own = [], []
        while at < len(tokens):
            t = tokens[at]
            if t == "]" and inside:
                return [*options, own], at + 1
            if t == "[":
                part, at = sequence(at + 1, True)
                own.append(part)
                continue
            if t == "|" and inside:
                options.append(own)
                own = []
            elif t[0] == "{":
                own.append(int(t[1:-1]))
            else:
                own.append(t)
            at += 1
        if inside:
            raise ValueError(f"a part of the template isn't closed: {template}")
        return own, at

    tokens = _MARKUP.findall(template)
    return sequence(0, False)[0]


class Automaton:
    """States are numbers; ``step[s]`` has (word or None for any, next state),
    ``free[s]`` the states that need no word."""

    def __init__(self, template: str):
        self.step: list[list[tuple[bytes | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        parts = parse(template)
        self.end = self._build(parts, 0)
        self.reach = [self._closure(s) for s in range(len(self.step))]
        self.first = {w for s in self.reach[0] for w, _ in self.step[s]}
        # runs of mandatory words, which a text must have to be worth a try
        self.needs, run = [], []
        for p in [*parts, 0]:
            if isinstance(p, str):
                run.append(p.encode())
            elif run:
                self.needs.append(b" " + b" ".join(run) + b" ")
                run = []

    def _new(self) -> int:
        self.step.append([])
        self.free.append([])
        return len(self.step) - 1

    def _build(self, parts: list, at: int) -> int:
        for p in parts:
            to = self._new()
            if isinstance(p, str):
                self.step[at].append((p.encode(), to))
            elif isinstance(p, int):
                self.free[at].append(to)
                for _ in range(p):
                    between = self._new()
                    self.step[at].append((None, between))
                    self.free[between].append(to)
                    at = between
            else:
                self.free[at].append(to)
                for option in p:
                    self.free[self._build(option, at)].append(to)
            at = to
        return at

    def _closure(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for n in self.free[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)

    def accepts(self, words: list[bytes], joined: bytes) -> bool:
        if any(n not in joined for n in self.needs):
            return False
        anything = None in self.first
        return any(
            (anything or w in self.first) and self._from(words, i) for i, w in enumerate(words)
        )

    def _from(self, words: list[bytes], at: int) -> bool:
        now = self.reach[0]
        while self.end not in now:
            if at == len(words) or not now:
                return False
            w = words[at]
            now = frozenset().union(
                *(self.reach[n] for s in now for x, n in self.step[s] if x is None or x == w)
            )
            at += 1
        return True


def places(joined: bytes, phrase: str) -> list[int]:
    """Numbers of the words at which the phrase starts, in `` w w ... w ``."""
    found, at, word, counted = [], 0, 0, 0
    mark = b" " + phrase.encode() + b" "
    while (at := joined.find(mark, at)) >= 0:
        word += joined.count(b" ", counted, at)
        counted = at
        found.append(word)
        at += 1
    return found


def scan(text: bytes | None, automata: dict[str, Automaton]):
    words = (text or b"").lower().translate(_TO_WORDS).split()
    joined = b" " + b" ".join(words) + b" "
    base = {label: places(joined, phrase) for phrase, label in PHRASES.items()}
    starts = [p for own in base.values() for p in own]
    found = [k for k, a in automata.items() if a.accepts(words, joined)]
    labels = sorted(k for k, own in base.items() if own)
    return (
        len(words),
        len(starts),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(labels),
        ",".join(sorted({*labels, *found})),
        1 - 2.0 ** -min(1000, 2 * len(found) + len(starts)),
    )


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double"
)
_TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id"):
    """For each document: its words, base places, labels and score."""
    templates = TEMPLATES if templates is None else templates
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        automata = {k: Automaton(t) for k, t in templates.items()}
        for b in batches:
            rows = [scan(t, automata) for t in b.column("body").to_pylist()]
            cols = list(zip(*rows, strict=True)) or [[]] * len(_TYPES)
            arrays = [pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays], names)

    python_batches(docs.sparkSession)
    own = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body")
    )
    return own.mapInArrow(run, SCHEMA)


def as_regex(template: str) -> str:
    """A pattern for `` w w ... w `` that matches where the template does."""

    def of(parts: list) -> str:
        out = ""
        for p in parts:
            if isinstance(p, str):
                out += " " + p
            elif isinstance(p, int):
                out += "(?: [^ ]+){0,%d}" % p
            else:
                out += "(?:" + "|".join(map(of, p)) + ")?"
        return out

    return of(parse(template)) + " "


def op6_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    each = [
        "list_transform(list_filter(range(1, len(w) + 1), lambda i: "
        + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
        + f"), lambda i: i - 1) AS p{n}"
        for n, phrase in enumerate(PHRASES)
    ]
    base = [f"CASE WHEN len(p{n}) > 0 THEN '{label}' END" for n, label in enumerate(PHRASES.values())]
    own = [f"CASE WHEN regexp_matches(j, '{as_regex(t)}') THEN '{k}' END" for k, t in TEMPLATES.items()]
    full = lambda xs: f"list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL)"
    all_ = " || ".join(f"p{n}" for n in range(len(PHRASES)))
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS j, {', '.join(each)} FROM d),
q AS (SELECT doc_id, len(w) AS n, {all_} AS a, {full(base)} AS bl, {full(own)} AS tl FROM p)
SELECT doc_id, cast(n AS BIGINT) AS n_words, cast(len(a) AS BIGINT) AS n_base,
       cast(list_min(a) AS BIGINT) AS first_word, cast(list_max(a) AS BIGINT) AS last_word,
       array_to_string(list_sort(bl), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(bl || tl)), ',') AS labels,
       1 - pow(2.0, -least(1000, 2 * len(tl) + len(a))) AS score
FROM q"""


OP6_SQL = _sql()
