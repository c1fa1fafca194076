import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfspark.functions.text import glob_regex
from shelfspark.functions.values import date_range, days_from_civil, number
from shelfspark.plans import query as q


def tag(*names):
    return [q.Tag(n) for n in names]


def test_precedence_and_juxtaposition():
    a, b, c = tag("a", "b", "c")
    assert q.parse("a || b, c") == q.Or(a, q.And(b, c))
    assert q.parse("a OR b AND NOT c") == q.Or(a, q.And(b, q.Not(c)))
    assert q.parse("(a || b) c") == q.And(q.Or(a, b), c)
    assert q.parse("this is fine") == q.Tag("this is fine")
    assert q.parse("--a") == q.Not(q.Not(a))
    assert q.parse('"a" b') == q.And(q.ExactTag("a"), b)
    assert q.parse("  ") == q.All()
    assert q.parse("blue-green") == q.Tag("blue-green")
    assert q.parse("band, orchid") == q.And(*tag("band", "orchid"))


def test_fields():
    assert q.parse("size.GT:1.5m") == q.Field("size", "gt", "1.5m")
    assert q.parse("T.w: tea ") == q.Field("text", "word", "tea")
    assert q.parse("width.word:3") == q.Tag("width.word:3")
    assert q.parse("artist:Someone") == q.Tag("artist:someone")
    assert q.parse("text:this OR that") == q.Or(q.Field("text", "eq", "this"), q.Tag("that"))
    assert q.parse('similar:"a, b.png"@20') == q.Field("similar", "eq", "a, b.png@20")
    assert q.similar_spec("a, b.png@7") == ("a, b.png", 7)
    assert q.similar_spec("icon@2x.png") == ("icon@2x.png", 20)


@pytest.mark.parametrize("text", ['"open', "(a", "a ||", "a)", "|| a", "NOT", "()"])
def test_errors(text):
    with pytest.raises(q.QuerySyntaxError):
        q.parse(text)


@pytest.mark.parametrize("text, caret, want", [("cat, do", 7, (5, 7, "do")), ("cat", 2, (0, 3, "ca")), ("size:3", 6, None), ("a || ", 5, None), ("-ca", 3, (1, 3, "ca")), ('"a, b', 5, (0, 5, "a, b")), ("x", 9, None)])
def test_completion(text, caret, want):
    assert q.completion(text, caret) == want


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet='ab ",\\()-!|&:*?ORandX', max_size=12))
def test_quoting_makes_any_tag_a_literal(name):
    if name.strip():
        assert q.parse(q.quote_tag(name)) == q.ExactTag(q.ascii_lower(name.strip()))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet='ab ",\\()-!|&:.', max_size=14), st.integers(0, 15))
def test_no_query_crashes(text, caret):
    try:
        q.parse(text)
    except q.QuerySyntaxError:
        pass
    q.completion(text, caret)


def by_table(pattern, text):
    """Whether a glob matches, by a table over both strings."""
    row = [True] + [False] * len(text)
    for p in pattern:
        new = [p == "*" and row[0]]
        for k, c in enumerate(text):
            new.append(row[k + 1] or new[k] if p == "*" else row[k] and (p == "?" or p == c))
        row = new
    return row[-1]


@settings(max_examples=1000, deadline=None)
@given(st.text(alphabet="ab*?.[(", max_size=7), st.text(alphabet="ab.[(\n", max_size=7))
def test_globs(pattern, text):
    import re

    assert bool(re.match(glob_regex(pattern).replace(r"\A", r"\A(?:", 1).replace(r"\z", r")\Z"), text)) == by_table(pattern, text)


@pytest.mark.parametrize("text, want", [("1000", 1000), ("1.5m", 1.5e6), ("1.5mb", 1.5e6), ("2K", 2e3), ("0.001g", 1e6), ("3bbb", 3), ("lots", None), ("1_000", None), ("1d", None), ("", None), ("1e3", 1000), ("-2k", -2000)])
def test_numbers(text, want):
    assert number(text) == want


def test_dates():
    assert date_range("2019") == (1546300800, 1577836800)
    assert date_range("2019-02") == (1548979200, 1551398400)
    assert date_range("2019/02/28") == (1551312000, 1551398400)
    assert date_range("2019-xx-05") == date_range("2019-05")
    assert date_range("soon") is None
    assert days_from_civil(2019, 13, 1) == days_from_civil(2020, 1, 1)


def test_sources_resolve():
    tree = q.parse("source:Disk, -source:a")
    assert q.resolve_sources(tree, {"a": "Attic", "b": "disk"}) == q.And(q.Field("source", "eq", "b"), q.Not(q.Field("source", "eq", "a")))
    with pytest.raises(q.QuerySyntaxError):
        q.resolve_sources(tree, {"a": "Attic"})
    assert q.parse(q.tier_query("a || b", "thin")) == q.parse("(a || b), tag_count.gt:0, tag_count.lt:3")
