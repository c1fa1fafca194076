"""The tag vocabulary: aliases, implications, suggestions, categories. Small enough for the driver; to_frames() makes tables of it.

Rules are kept as sets of (from, to) pairs, so order and repeats never matter.
"""

from __future__ import annotations

import hashlib
import json
import re
import tomllib
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DENIAL = "not:"
# The built-in categories in their order; others follow by name, and `other` is last.
CATEGORIES = ("character", "series", "artist", "subject", "commentary", "theme", "format", "action")

Pairs = frozenset[tuple[str, str]]


def relation(tag: str) -> tuple[str, str] | None:
    """(modifier, target) of modifier<target>; None if the tag isn't of that shape or is nested."""
    m = re.fullmatch(r"([^<]*)<([^<>]*)>", tag, re.S)
    parts = m and (m[1].strip(), m[2].strip())
    return parts if parts and all(parts) else None


def denied(tag: str) -> str:
    return DENIAL + tag


@dataclass(frozen=True)
class Rename:
    """What a rename did: the new vocabulary, whether it differs, and targets that stayed behind."""

    vocabulary: Vocabulary
    changed: bool
    left_behind: tuple[str, ...] = ()


@dataclass(frozen=True)
class Vocabulary:
    aliases: dict[str, str] = field(default_factory=dict)
    implications: Pairs = frozenset()
    suggestions: Pairs = frozenset()
    categories: dict[str, str] = field(default_factory=dict)
    colors: dict[str, str] = field(default_factory=dict)
    broken: bool = False

    @classmethod
    def of(cls, aliases=None, implications=None, suggestions=None, categories=None, colors=None, broken=False) -> Vocabulary:
        """From tables as a rule file has them: lists of targets by tag, tags by category.

        Categories and their tags are trimmed and lower-cased; a tag in several categories is in the first by name.
        """

        def flat(table):
            return frozenset((k, v) for k, vs in (table or {}).items() for v in vs)

        folded: dict[str, str] = {}
        for category, tags in sorted((c.strip().lower(), ts) for c, ts in (categories or {}).items()):
            for t in tags:
                folded.setdefault(t.strip().lower(), category)
        return cls(dict(aliases or {}), flat(implications), flat(suggestions), folded, dict(colors or {}), broken)

    @classmethod
    def loads(cls, text: str) -> Vocabulary:
        """From TOML; text that can't be read gives empty rules, marked broken."""
        try:
            raw = tomllib.loads(text)
            return cls.of(**{k: raw.get(k) for k in ("aliases", "implications", "suggestions", "categories", "colors")})
        except (tomllib.TOMLDecodeError, AttributeError, TypeError):
            return cls(broken=True)

    # -- tags

    def canon(self, tag: str) -> str:
        """Trimmed, lower case, one alias hop; the parts of a relational tag each on their own."""
        t = tag.strip().lower()
        parts = relation(t)
        if parts:
            return f"{self.canon(parts[0])}<{self.canon(parts[1])}>"
        return self.aliases.get(t, t).strip().lower()

    def _next(self, tag: str) -> set[str]:
        return set(relation(tag) or ()) | {self.canon(to) for own, to in self.implications if own == tag}

    def expand(self, tags) -> set[str]:
        """The canonical tags and all that they imply, through any number of rules; cycles end."""
        seen: set[str] = set()
        edge = {self.canon(t) for t in tags}
        while edge:
            seen |= edge
            edge = set().union(*map(self._next, edge)) - seen
        return seen

    def implies(self, tag: str, other: str) -> bool:
        return tag != other and other in self.expand([tag])

    def suggests(self, tags: set[str]) -> list[str]:
        """Suggestions keyed on any of the tags, less those carried or denied."""
        offered = {self.canon(to) for own, to in self.suggestions if own in tags}
        return sorted(s for s in offered if s and not s.startswith(DENIAL) and s not in tags and denied(s) not in tags)

    def category_of(self, tag: str) -> str | None:
        while tag not in self.categories:
            parts = relation(tag)
            if tag.startswith(DENIAL):
                tag = tag[len(DENIAL) :]
            elif parts:
                tag = parts[1]
            else:
                return {"artist": "artist", "oc": "character"}.get(tag.partition(":")[0]) if ":" in tag else None
        return self.categories[tag]

    def category_order(self) -> list[str]:
        extra = (set(self.categories.values()) | set(self.colors)) - {*CATEGORIES, "other"}
        return [*CATEGORIES, *sorted(extra), "other"]

    def color_of(self, category: str) -> tuple[int, int, int] | None:
        m = re.fullmatch(r"#([0-9a-fA-F]{6})", self.colors.get(category, ""))
        return tuple(bytes.fromhex(m[1])) if m else None

    # -- changes

    def with_rule(self, tag: str, to: str) -> Vocabulary:
        return replace(self, implications=self.implications | {(tag, to)})

    def without_rule(self, tag: str, to: str) -> Vocabulary:
        return replace(self, implications=self.implications - {(tag, to)})

    def with_suggestion(self, tag: str, to: str) -> Vocabulary:
        return replace(self, suggestions=self.suggestions | {(tag, to)})

    def without_suggestion(self, tag: str, to: str) -> Vocabulary:
        return replace(self, suggestions=self.suggestions - {(tag, to)})

    def rename(self, old: str, new: str) -> Rename:
        """Rules, suggestions, category and aliases of a tag under its new name.

        A new name that rules or aliases already know doesn't take over the old one's implications; they are left
        behind, as is a rule that would lead from the new name to itself.
        """
        if old == new:
            return Rename(self, False)
        own = {to for tag, to in self.implications if tag == old}
        rest = {(tag, to) for tag, to in self.implications if tag != old}
        known = new in {x for pair in rest for x in pair} | self.aliases.keys() | set(self.aliases.values())
        left = sorted(own if known else own & {new})
        rest |= set() if known else {(new, to) for to in own if to != new}

        def moved(pairs):
            return frozenset((tag, new if to == old else to) for tag, to in pairs if tag != (new if to == old else to))

        suggested = {(new if tag == old else tag, to) for tag, to in self.suggestions}
        categories = {t: c for t, c in self.categories.items() if t != old}
        if old in self.categories:
            categories.setdefault(new, self.categories[old])
        out = replace(
            self,
            aliases={k: new if v == old else v for k, v in self.aliases.items()},
            implications=moved(rest),
            suggestions=moved(suggested),
            categories=categories,
        )
        return Rename(out, out != self, tuple(left))

    # -- listing and comparing

    def body(self) -> str:
        """The rules as text that is equal for equal rules, whatever file they came from."""

        def lists(pairs):
            grouped: dict[str, list[str]] = {}
            for k, v in sorted(pairs):
                grouped.setdefault(k, []).append(v)
            return [f"{_key(k)} = [{', '.join(map(json.dumps, vs))}]" for k, vs in grouped.items()]

        def plain(table):
            return [f"{_key(k)} = {json.dumps(v)}" for k, v in sorted(table.items())]

        out = ["[aliases]", *plain(self.aliases), "", "[implications]", *lists(self.implications)]
        for name, rows in (("suggestions", lists(self.suggestions)), ("categories", lists((c, t) for t, c in self.categories.items())), ("colors", plain(self.colors))):
            out += ["", f"[{name}]", *rows] if rows else []
        return "\n".join(out) + "\n"

    def fingerprint(self) -> str:
        return hashlib.sha256(self.body().encode()).hexdigest()

    def lines(self) -> set[str]:
        """Every rule as one line of display."""
        return (
            {f"{a} ⇒ {b}" for a, b in self.implications}
            | {f"{a} suggests {b}" for a, b in self.suggestions}
            | {f"{t} is a {c}" for t, c in self.categories.items()}
            | {f"{c} is tinted {h}" for c, h in self.colors.items()}
            | {f"{a} = {b}" for a, b in self.aliases.items()}
        )

    # -- tables

    def known_tags(self) -> set[str]:
        return {x for pair in self.implications for x in pair} | self.aliases.keys() | set(self.aliases.values())

    def to_frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        """aliases(key, target), rules(tag, to), suggestions(tag, to), categories(tag, category), closure(tag, implied)."""
        starts = {t for t, _ in self.implications} | {t for t in self.known_tags() if relation(t)}
        closure = sorted((t, x) for t in starts for x in self.expand([t]) - {t})
        rows = {
            "aliases": (sorted(self.aliases.items()), "key string, target string"),
            "rules": (sorted(self.implications), "tag string, to string"),
            "suggestions": (sorted((a, self.canon(b)) for a, b in self.suggestions), "tag string, to string"),
            "categories": (sorted(self.categories.items()), "tag string, category string"),
            "closure": (closure, "tag string, implied string"),
        }
        return {k: spark.createDataFrame([list(r) for r in v], s) for k, (v, s) in rows.items()}


def _key(k: str) -> str:
    return k if re.fullmatch(r"[A-Za-z0-9_-]+", k) else json.dumps(k)


def diff(local: Vocabulary, other: Vocabulary) -> tuple[list[str], list[str]]:
    """Lines only in the first and only in the second."""
    a, b = local.lines(), other.lines()
    return sorted(a - b), sorted(b - a)


def merge(local: Vocabulary, other: Vocabulary) -> tuple[Vocabulary, list[tuple[str, str, str]]]:
    """The union, and aliases (key, local target, other target) on which the two disagree; local wins those, categories and colours."""
    clashes = sorted((k, local.aliases[k], v) for k, v in other.aliases.items() if local.aliases.get(k, v) != v)
    out = Vocabulary(
        other.aliases | local.aliases, local.implications | other.implications, local.suggestions | other.suggestions,
        other.categories | local.categories, other.colors | local.colors, local.broken,
    )
    return out, clashes


def decide(local: str, other: str | None, base: str | None) -> str:
    """seed, in_sync, push, pull or conflict, from the fingerprints of the local rules, the shared ones and those of the last sync."""
    if other is None:
        return "seed"
    if local == other:
        return "in_sync"
    if base is not None and other == base:
        return "push"
    if base is not None and local == base:
        return "pull"
    return "conflict"


def decisions(local: Column, other: Column, base: Column) -> Column:
    """decide() for columns of fingerprints."""
    return (
        F.when(other.isNull(), "seed").when(local == other, "in_sync").when(other == base, "push").when(local == base, "pull").otherwise("conflict")
    )
