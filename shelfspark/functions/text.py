"""Column functions over text: globs, words, markup and the clean-up of machine-read text. All run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

#: What separates words: runs of letters and digits of any alphabet are words.
NOT_WORD = r"[^\p{IsAlphabetic}\p{N}]+"


def has_wildcard(pattern: str) -> bool:
    return "*" in pattern or "?" in pattern


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob over lower-case text: * is any run, ? one character."""
    body = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if re.match(r"[^\w\s]", c) and ord(c) < 128 else c for c in re.sub(r"\*+", "*", pattern.lower()))
    return rf"(?s)\A{body}\z"


def glob_match(col, pattern: str):
    return F.lower(col).rlike(glob_regex(pattern))


def words(col):
    """The words of a text as they stand."""
    return F.filter(F.split(col, NOT_WORD), lambda w: w != "")


def terms(col):
    """Lower-case words of two characters or more, for ranking."""
    return F.filter(F.split(F.lower(col), NOT_WORD), lambda w: F.char_length(w) >= 2)


def driver_words(value: str) -> list[str]:
    """The words of a literal, split as words() does."""
    return [w for w in re.split(r"[^\w]|_", value) if w]


def has_words(col, value: str):
    """The value's words stand next to each other in the text, as whole words; with wildcards each of its blank-separated patterns matches one word.

    One regular expression over the lower-case text: no list of words is built for a row.
    """
    letter = r"[\p{IsAlphabetic}\p{N}]"
    if has_wildcard(value):
        wanted = [[(c if c in "*?" else None, c) for c in w.lower()] for w in value.split()]
        if any(not (k or c.isalnum()) for w in wanted for k, c in w):  # no word holds such a character
            return F.lit(False)
        parts = ["".join({"*": letter + "*", "?": letter}.get(k, c) for k, c in w) for w in wanted]
    else:
        parts = [w.lower() for w in driver_words(value)]
    if not parts:
        return F.lit(False)
    return F.lower(col).rlike(f"(?<!{letter})" + NOT_WORD.join(parts) + f"(?!{letter})")


def strip_tags(col):
    """Markup replaced by spaces: < opens a tag only before a letter, / or !; one that never closes stays text."""
    return F.regexp_replace(col, "<[A-Za-z/!][^>]*>", " ")


def _once(col, use):
    """use(col) with col computed once a row, however often use names it."""
    return F.get(F.transform(F.array(col), use), 0)


def _lines(col):
    return F.split(col, "\n", -1)


def _no_repeats(lines):
    """Lines without those equal to the one before."""
    return _once(lines, lambda all_: F.filter(all_, lambda x, i: (i == 0) | (F.get(all_, i - 1) != x)))


def utf8_head(col, limit: int):
    """The longest beginning of at most so many UTF-8 bytes that ends between characters."""

    def head(whole):
        cut = F.substring(whole.cast("binary"), 1, limit)
        # A cut character leaves up to three bytes; the first shortening that is valid UTF-8 is whole.
        tries = [F.when(F.is_valid_utf8(t.cast("string")), t.cast("string")) for t in (F.substring(cut, 1, limit - k) for k in range(4))]
        return F.when(F.octet_length(whole) <= limit, whole).otherwise(F.coalesce(*tries))

    return _once(col, head)


def clean_model_text(col, limit: int = 4000):
    """Text that a model read: markup off, blanks collapsed, empty and repeated lines off; `none` and degenerate answers are empty."""
    squeezed = F.transform(_lines(strip_tags(col)), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    lines = _no_repeats(F.filter(squeezed, lambda x: x != ""))

    def sound(text, toks, solid):
        letters = F.char_length(F.regexp_replace(solid, r"[^\p{IsAlphabetic}]", ""))
        few_kinds = (F.size(toks) >= 8) & (F.size(F.array_distinct(toks)) * 4 < F.size(toks))
        few_letters = letters * 10 < F.char_length(solid) * 3
        no_word = ~F.exists(toks, lambda t: F.char_length(F.regexp_replace(t, r"[^\p{IsAlphabetic}]", "")) >= 3)
        one_long = (F.size(toks) == 1) & (F.char_length(text) > 24)
        bad = F.lower(text).isin("none", "none.") | few_kinds | few_letters | no_word | one_long
        return F.when(F.coalesce(bad, F.lit(True)), "").otherwise(utf8_head(text, limit))

    def parts(text):
        toks = F.filter(F.split(text, r"\s+"), lambda t: t != "")
        return _once(toks, lambda t: _once(F.regexp_replace(text, r"\s", ""), lambda solid: sound(text, t, solid)))

    return _once(F.array_join(lines, "\n"), parts)


def clean_scanned_text(col, limit: int = 4000):
    """Text that a scanner read: lines of two letters or digits at least, which make up half of the line."""

    def solid(x):
        return F.char_length(F.regexp_replace(x, r"[^\p{IsAlphabetic}\p{N}]", ""))

    kept = F.filter(F.transform(_lines(col), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: (solid(x) >= 2) & (solid(x) * 2 >= F.char_length(x)))
    return utf8_head(F.array_join(kept, "\n"), limit)


# The headers of the machine's sections of a text.
HEADERS = ("English (machine):", "Speech (machine):", "Description (machine):")


def _header_regex(headers) -> str:
    return "(?:" + "|".join(h.replace("(", r"\(").replace(")", r"\)") for h in headers) + ")"


def split_blocks(col):
    """struct(text, blocks): what stands before the first machine section, right-trimmed, and the sections."""
    head = F.regexp_extract(col, rf"(?s)\A(.*?)(?:{_header_regex(HEADERS)}|\z)", 1)
    return F.struct(F.regexp_replace(head, r"\s+\z", "").alias("text"), F.substring(col, F.char_length(head) + 1, F.char_length(col)).alias("blocks"))


def with_block(col, header: str, body):
    """The text with the section under header replaced, or added at the end after a blank line."""
    others = _header_regex([h for h in HEADERS if h != header])
    rest = F.regexp_replace(col, rf"(?s){_header_regex([header])}.*?(?={others}|\z)", "")
    rest = F.regexp_replace(rest, r"\s+\z", "")
    block = F.concat(F.lit(header + "\n"), F.trim(body))
    return F.when(rest == "", block).otherwise(F.concat(rest, F.lit("\n\n"), block))
