"""Fixed-width bit hashes in four bigint words h0 to h3."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

WORDS = ("h0", "h1", "h2", "h3")
#: Hashes with more bits set are flat and say nothing.
MOST_BITS = 144


def signed(word: int) -> int:
    """An unsigned 64-bit word as a bigint."""
    return word - (1 << 64) if word >> 63 else word


def ones(prefix: str = "", words: Sequence[str] = WORDS):
    out = F.lit(0)
    for w in words:
        out = out + F.bit_count(F.col(prefix + w))
    return out


def informative(prefix: str = ""):
    return F.coalesce(ones(prefix) <= MOST_BITS, F.lit(False))


def distance(literal: Sequence[int], prefix: str = ""):
    """Differing bits between a row's hash and a literal one; null without a hash."""
    out = F.lit(0)
    for w, v in zip(WORDS, literal):
        out = out + F.bit_count(F.col(prefix + w).bitwiseXOR(F.lit(v)))
    return out


def between(left: str, right: str, words: Sequence[str] = WORDS):
    """Differing bits between two hashes of one row, named by prefixes."""
    out = F.lit(0)
    for w in words:
        out = out + F.bit_count(F.col(left + w).bitwiseXOR(F.col(right + w)))
    return out


def words_of(blob):
    """struct(h0 .. h3) of 32 bytes, eight a word, the highest first; null for other lengths."""
    word = lambda k: F.conv(F.hex(F.substring(blob, 8 * k + 1, 8)), 16, -10).cast("bigint").alias(WORDS[k])
    return F.when(F.octet_length(blob) == 32, F.struct(*[word(k) for k in range(4)]))


def blob_of(prefix: str = ""):
    """The reverse: 32 bytes of a row's four words."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.col(prefix + w)), 16, "0") for w in WORDS]))
