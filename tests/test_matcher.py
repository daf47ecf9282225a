from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.functions import forms, matcher
from textloom.functions.matcher import Term, match

TEXT = st.text(alphabet="aAbB_-./ é́ßカかｶ1２\r\n😀", max_size=24)


def test_whole_word_beats_an_earlier_part():
    assert match("tables, able", Term("able"))["start"] == 8


def test_folding_expands_and_ranges_point_into_the_source():
    hit = match("die Straße!", Term("STRASSE"))
    assert (hit["kind"], hit["start"], hit["end"]) == ("caseFolded", 4, 10)


def test_standard_mode_keeps_width_apart_and_fuzzy_mode_does_not():
    assert match("Ｆｏｏ", Term("foo")) is None
    assert match("Ｆｏｏ", Term("foo"), True)["kind"] == "normalized"


def test_fuzzy_rules_in_order():
    assert match("かたかな", Term("カタカナ"), True)["kind"] == "kanaVariant"
    assert match("user_name", Term("userName"), True)["kind"] == "identifier"
    assert match("user name", Term("userName"), True)["kind"] == "separatorVariant"
    assert match("getUserName", Term("user"), True)["kind"] == "identifier"
    assert match("getUsersNow", Term("user"), True)["kind"] == "prefix"
    assert match("a recieve b", Term("receive"), True) is None  # a transposition is two edits
    assert match("a receve b", Term("receive"), True)["kind"] == "editDistance"


def test_fuzzy_hit_that_standard_search_finds_too_is_standard():
    assert match("abc", Term("ABC"), True)["category"] == "standard"


def test_numeric_terms_keep_separators():
    assert match("1/2", Term("12"), True) is None


def test_bounded_distance():
    assert matcher.bounded_distance("kitten", "sitten", 1) == 1
    assert matcher.bounded_distance("kitten", "sitting", 2) is None
    assert matcher.bounded_distance("kitten", "sitting", 3) == 3


def test_tokens_of_queries_cut_at_digits_and_those_of_texts_do_not():
    assert forms.tokens("HTTPServer2Go_x") == ["http", "server", "2", "go", "x"]
    assert [t for t, _, _ in forms.spans_of_tokens("HTTPServer2Go_x")] == ["http", "server2go", "x"]


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT)
def test_every_fuzzy_match_is_a_candidate_and_every_standard_match_is_fuzzy(text, raw):
    term = Term(raw)
    if not term.raw:
        return
    hit = match(text, term, True)
    if hit:
        assert matcher.candidate(text, term)
        assert 0 <= hit["start"] < hit["end"] <= len(text)
    if match(text, term):
        assert hit


@settings(max_examples=200, deadline=None)
@given(TEXT, st.text(alphabet="aAbé ", min_size=1, max_size=3))
def test_standard_match_is_a_folded_substring(text, raw):
    term = Term(raw)
    if term.raw and text.isascii():
        assert bool(match(text, term)) == (term.base in text.casefold())
