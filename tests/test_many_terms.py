"""Searches of many terms in one pass equal those by a test for each term."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import automaton, forms
from textloom.operators import search
from textloom.plans.request import NamedTerm, Scope, parse_conditions
from textloom.sources import files

pytestmark = pytest.mark.skipif(automaton.ahocorasick is None, reason="without the automaton's library there is one path only")
TERMS = ("a", "ab", "aba", "a-a", "Straße", "STRASSE", "fi", "é", "ét", "the", "The", "he", "_x", "x_", "漢字", "字", "が", "ß", "thethe", "b b", "İ", "ς")
PIECES = ("a", "b", "ab", "ABA", " ", "-", "_", "x", "the", "The", "THE", "he", "straße", "STRASSE", "ﬁ", "fi", "é", "é", "t", "漢", "字", "が", "が", "ß", "ss", "İ", "i", "Σ", "ς", "\r", "1", ".")


def units(spark, texts):
    return spark.createDataFrame([(f"p{i % 7}", "txt", i, t, "textLine", "body") for i, t in enumerate(texts)], "path string, file_type string, unit_seq int, text string, source_kind string, content_class string")


def told(df):
    return sorted(((r.unit_seq, r.term_ord, r.term_id, r.term, tuple(r.hit) if r.hit else None) for r in df.collect()), key=repr)


def test_equal_to_a_test_for_each_term(spark, monkeypatch):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 12))) for _ in range(1500)] + [None, ""]
    df = units(spark, texts)
    terms, out = tuple(NamedTerm(f"all:{i}", t) for i, t in enumerate(TERMS[:16])), tuple(NamedTerm(f"not:{i}", t) for i, t in enumerate(TERMS[16:]))
    for args in ({}, {"identifiers": True}, {"excluded": out}):
        monkeypatch.setattr(automaton, "MANY", 10_000)
        want = told(search.matched(df, terms, **args))
        monkeypatch.setattr(automaton, "MANY", 0)
        got = told(search.matched(df, terms, **args))
        assert got == want and len(got) > 300


def test_conditions_of_many_terms(spark, monkeypatch):
    rnd = random.Random(9)
    texts = [(f"p{i}", "\n".join(" ".join(rnd.choice(TERMS + ("word", "more")) for _ in range(8)) for _ in range(4))) for i in range(100)]
    df = files.line_units(spark.createDataFrame(texts, "p string, text string"), F.col("p"))
    spec = parse_conditions({"mode": "conditions", "scope": "unit", "all": ["the", "a"], "any": list(TERMS[4:14]), "not": ["漢字", "x_"]})
    assert spec.scope is Scope.UNIT
    rows = lambda: sorted((r.path, r.scope_key, r.category, len(r.evidence)) for r in search.where(df, spec).collect())
    got = rows()
    monkeypatch.setattr(automaton, "MANY", 10_000)
    assert got == rows() != []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab -", min_size=1, max_size=4), min_size=1, max_size=6, unique=True), st.text(alphabet="abAB -1", max_size=30))
def test_every_occurrence_is_seen(terms, text):
    made = automaton.built(tuple(terms))
    got = sorted((s, e, i) for s, e, ords in automaton.occurrences(made, text) for i in ords)
    assert got == sorted((s, s + len(t), i) for i, t in enumerate(terms) for s in range(len(text)) if text.startswith(t, s))
    best = automaton.in_plain(text, text.lower(), automaton.built(tuple(map(forms.base, terms))), tuple(terms))
    for i, t in enumerate(terms):
        at = [s for s in range(len(text)) if text.lower().startswith(t, s)]
        whole = [s for s in at if automaton.bounded(text, s, s + len(t))]
        exact = [s for s in whole if text.startswith(t, s)]
        assert best.get(i) == ((2, exact[0]) if exact else (1, whole[0]) if whole else (0, at[0]) if at else None)
