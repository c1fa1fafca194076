from hypothesis import given, settings
from hypothesis import strategies as st

from shelfspark.operators.vocabulary import Vocabulary, decide, diff, merge, relation


def test_canon_and_relations():
    v = Vocabulary.of(aliases={"pg": "Peter Griffin", "chib": "chibi"})
    assert v.canon(" PG ") == "peter griffin"
    assert v.canon("Chib<PG>") == "chibi<peter griffin>"
    assert relation("a<b>") == ("a", "b") and relation("a<b<c>>") is None and relation("<b>") is None and relation("a<b>c") is None


def test_expand_and_suggest():
    v = Vocabulary.of(implications={"a": ["b"], "b": ["c"], "c": ["a"]}, suggestions={"catgirl": ["kitty paw hand"], "kemonomimi": ["tail"], "succubus": ["horns", "wings", "tail"]})
    assert v.expand(["a"]) == {"a", "b", "c"} and v.implies("a", "c") and not v.implies("a", "a")
    assert v.expand(["x<b>"]) == {"x<b>", "x", "a", "b", "c"}
    assert v.suggests({"catgirl", "kemonomimi"}) == ["kitty paw hand", "tail"]
    assert v.suggests({"catgirl", "kemonomimi", "not:tail"}) == ["kitty paw hand"]
    assert v.suggests({"succubus", "horns"}) == ["tail", "wings"]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 11), st.integers(0, 11)), max_size=30), st.integers(0, 11))
def test_closure_is_reachability(edges, start):
    v = Vocabulary(implications=frozenset((f"t{a}", f"t{b}") for a, b in edges))
    reach = [[a == b or (a, b) in edges for b in range(12)] for a in range(12)]
    for k in range(12):
        for a in range(12):
            for b in range(12):
                reach[a][b] |= reach[a][k] and reach[k][b]
    assert v.expand([f"t{start}"]) == {f"t{b}" for b in range(12) if reach[start][b]}


def test_categories():
    v = Vocabulary.of(categories={"series": ["lain"], "mood": ["sad"]})
    assert [v.category_of(t) for t in ("lain", "not:lain", "chibi<lain>", "artist:x", "oc:y", "z")] == ["series", "series", "series", "artist", "character", None]
    assert v.category_order()[-2:] == ["mood", "other"]


def test_rename():
    v = Vocabulary.of(aliases={"x": "old"}, implications={"old": ["general"], "deep": ["old"]}, suggestions={"old": ["s", "new"]}, categories={"series": ["old"]})
    r = v.rename("old", "new")
    assert r.changed and r.left_behind == ()
    assert r.vocabulary.implications == {("new", "general"), ("deep", "new")}
    assert r.vocabulary.suggestions == {("new", "s")} and r.vocabulary.aliases == {"x": "new"} and r.vocabulary.categories == {"new": "series"}
    known = Vocabulary.of(implications={"old": ["general"], "new": ["top"]}).rename("old", "new")
    assert known.left_behind == ("general",) and known.vocabulary.implications == {("new", "top")}
    assert not v.rename("old", "old").changed and not v.rename("none", "new").changed


def test_files_and_sync():
    a = Vocabulary.loads('[aliases]\nx = "y"\n[implications]\nb = ["c", "a"]\n')
    b = Vocabulary.loads('# same\n[implications]\nb = ["a", "c", "a"]\n[aliases]\nx = "y"\n')
    assert a.fingerprint() == b.fingerprint() and Vocabulary.loads("[[[").broken
    assert decide("l", None, None) == "seed" and decide("l", "l", None) == "in_sync"
    assert decide("l", "c", None) == "conflict" and decide("l", "c", "c") == "push" and decide("l", "c", "l") == "pull" and decide("l", "c", "b") == "conflict"
    c = Vocabulary.of(aliases={"x": "z", "q": "r"}, implications={"b": ["d"]})
    merged, clashes = merge(a, c)
    assert clashes == [("x", "y", "z")] and merged.aliases == {"x": "y", "q": "r"} and ("b", "d") in merged.implications and ("b", "a") in merged.implications
    assert diff(a, c)[1] == ["b ⇒ d", "q = r", "x = z"]


def test_categories_are_folded():
    v = Vocabulary.loads('[categories]\nzeta = ["Cat "]\nalpha = ["cat"]\nSeries = ["x"]\n')
    assert v.categories == {"cat": "alpha", "x": "series"}
