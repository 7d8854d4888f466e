import re

from lumenql.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def labels_of(text):
    a = {k: licenses.Automaton(t) for k, t in licenses.TEMPLATES.items()}
    return licenses.scan(text.encode(), a)


def test_automata_accept_what_the_patterns_match():
    words = "licensed under the apache a license version 2 0 cc by nc gpl this work is released mit terms of".split()
    import random

    r = random.Random(1)
    for k, t in licenses.TEMPLATES.items():
        a, p = licenses.Automaton(t), re.compile(licenses.as_regex(t))
        fixed = [w for w in re.findall(r"[^\s\[\]|{}]+", re.sub(r"\{\d+\}", " x y ", t))]
        for _ in range(200):
            w = [x for x in fixed if r.random() < 0.93]
            for _ in range(r.randint(0, 2)):
                w.insert(r.randint(0, len(w)), r.choice(words))
            joined = " " + " ".join(w) + " "
            assert a.accepts([x.encode() for x in w], joined.encode()) == bool(p.search(joined)), (k, joined)


def test_mandatory_words_must_match_exactly():
    assert labels_of("Released under the MIT License.")[5] == "mit"
    assert labels_of("x Released, under THE terms of the MIT-License y")[5] == "mit"
    assert labels_of("Released under a MIT License.")[5] == ""
    assert labels_of("Licensed under the Apache License, Version 2.0.")[5] == "apache-2.0"
    assert labels_of("Licensed under the Apache License, Version 1.0.")[5] == ""
    assert labels_of("Copyright (c) 2020 Some One. All rights reserved.")[4:6] == ("reserved", "reserved,rights-notice")
    got = labels_of("This work is licensed under the GNU General Public License, version 3.")
    assert got[4:6] == ("gpl", "gpl,gpl-3.0")


def test_places_are_all_counted():
    assert licenses.places(b" cc by cc by cc ", "cc by") == [0, 2]
    assert licenses.places(b" x all rights reserved all rights reserved ", "all rights reserved") == [1, 4]
    got = labels_of("CC-BY and cc/by; General Public License")
    assert got[:5] == (8, 3, 0, 5, "cc-by,gpl")


def test_nulls_empty_long_and_repeated_rows(spark, docs):
    d = docs((1, None, "x"), (2, "", "x"), (3, "all rights reserved " * 40000, "x"), (4, "Á cc by", "x"), (4, "Á cc by", "x"), (None, "mit", "x"), extra=", labels string")
    got = sorted((tuple(r) for r in licenses.scan_licenses(d).collect()), key=lambda r: r[0] or 0)
    assert got[0] == (None, 1, 0, None, None, "", "", 0.0)
    assert got[1][1:] == got[2][1:] == (0, 0, None, None, "", "", 0.0)
    assert got[3][1:6] == (120000, 40000, 0, 119997, "reserved") and got[3][7] == 1.0
    assert got[4] == got[5] == (4, 3, 1, 1, 1, "cc-by", "cc-by", 0.5)
    assert licenses.scan_licenses(docs()).collect() == []


def test_templates_must_be_closed():
    import pytest

    with pytest.raises(ValueError):
        licenses.Automaton("a [b")
