"""What a fuzzy search shows to Python, and the short way of folding."""

import random

from textloom.functions import forms
from textloom.functions.matcher import Term, match
from textloom.operators import index

TERMS = ("thtion", "username", "größe", "x1", "ab-cd", "straße")


def texts():
    rnd = random.Random(7)
    parts = [*TERMS, "thtoin", "thtionx", "thion", "userNmae", "GRÖSSE", "Größen", "ﬁ", "ｔｈｔｉｏｎ", "é", "été", "x 1", "the", "Ж", "日本", " ", "_", ".", "\r\n", "12", "ß", "throne", "tht ion"]
    return ["".join(rnd.choice(parts) + rnd.choice(["", " ", " "]) for _ in range(rnd.randint(1, 5))) for _ in range(1500)]


def test_every_match_is_possible_and_other_scripts_are_judged(spark):
    some = texts()
    made = spark.createDataFrame([(t,) for t in some], "text string")
    for raw in TERMS:
        term = Term(raw)
        can = {r.text for r in made.where(index.possible("text", term)).select("text").distinct().collect()}
        assert {t for t in some if match(t, term, True)} <= can
    usual = spark.createDataFrame([("été throne naïve",), ("été thtoin",), ("ça thion",), ("déjà THTIONx",)], "text string")
    assert {r.text for r in usual.where(index.possible("text", Term("thtion"))).collect()} == {"ça thion", "déjà THTIONx"}


def test_short_way_of_folding_gives_the_same_ranges(monkeypatch):
    some = texts()
    ways = [(t, f) for t in some for f in forms.FORMS]
    short = [(forms.Folded(t, f).value, [forms.Folded(t, f).range(i, 1) for i in range(len(forms.Folded(t, f).value))]) for t, f in ways]
    monkeypatch.setattr(forms, "_ALONE", forms.regex.compile(r"(?!)"))
    assert short == [(forms.Folded(t, f).value, [forms.Folded(t, f).range(i, 1) for i in range(len(forms.Folded(t, f).value))]) for t, f in ways]
