"""Width and height from the first bytes of images, as folds over the bytes: nothing is decoded."""

from __future__ import annotations

from pyspark.sql import functions as F

from .names import sniff

#: Five nested folds of 64 steps reach every segment of a file of 2 GB (a segment has at least two bytes); the inner ones
#: are passed over as soon as the walk has ended, so a common header costs a few hundred steps.
_STEPS, _LEVELS = 64, 5


def _number(content, at, size: int, little: bool = False):
    """The unsigned number of size bytes at a position counted from 0; null where the bytes end before."""
    part = F.substring(content, at + 1, F.lit(size))
    digits = F.hex(part)
    if little:
        digits = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])
    return F.when(F.octet_length(part) == size, F.conv(digits, 16, 10).cast("bigint"))


def _at(content, at, size: int, little: bool = False):
    return _number(content, F.lit(at), size, little)


def _state(pos, width, height, done):
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return F.struct(zero(pos).alias("pos"), zero(width).alias("width"), zero(height).alias("height"), done.alias("done"))


def _segment(content, state):
    """One step over a JPEG: a fill byte, a marker without a length, a segment, or the frame header with the dimensions.

    The nine bytes of the step are read once, as hex digits.
    """
    none, no, yes = F.lit(0), F.lit(False), F.lit(True)

    def step(digits):
        pos, mark = state["pos"], F.substring(digits, 3, 2)
        number = lambda at: F.conv(F.substring(digits, 2 * at + 1, 4), 16, 10).cast("bigint")
        frames = [f"{m:02X}" for m in range(0xC0, 0xD0) if m not in (0xC4, 0xC8, 0xCC)]
        return (
            F.when((F.length(digits) < 4) | (F.substring(digits, 1, 2) != "FF") | mark.isin("D9", "DA"), _state(pos, none, none, yes))
            .when(mark == "FF", _state(pos + 1, none, none, no))
            .when(mark.isin("01", *[f"D{k}" for k in range(9)]), _state(pos + 2, none, none, no))
            .when((F.length(digits) < 8) | (number(2) < 2), _state(pos, none, none, yes))
            .when(mark.isin(*frames), F.when(F.length(digits) == 18, _state(pos, number(7), number(5), yes)).otherwise(_state(pos, none, none, yes)))
            .otherwise(_state(pos + 2 + number(2), none, none, no))
        )

    return F.get(F.transform(F.array(F.hex(F.substring(content, state["pos"] + 1, F.lit(9)))), step), F.lit(0))


def _walk(content, start, level: int, finish=None):
    step = (lambda s: _segment(content, s)) if level == 1 else (lambda s: _walk(content, s, level - 1))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), start, lambda s, _: F.when(s["done"], s).otherwise(step(s)), finish)


def _pair(width, height):
    """Both numbers, or zeros where the header is cut off."""
    whole = width.isNotNull() & height.isNotNull()
    return F.struct(F.when(whole, width).otherwise(0).cast("bigint").alias("width"), F.when(whole, height).otherwise(0).cast("bigint").alias("height"))


def dimensions(content):
    """struct(width, height) of JPEG, PNG (animated too), GIF and WebP (lossy, lossless, extended) bytes; zeros for other formats and broken headers.

    The size of a JPEG stands behind any number of other segments, over which the fold walks by their lengths.
    """
    kind, start = sniff(content), _state(F.lit(2), F.lit(0), F.lit(0), F.lit(False))
    jpeg = _walk(content, start, _LEVELS, lambda s: F.struct(s["width"].alias("width"), s["height"].alias("height")))
    chunk = F.hex(F.substring(content, 13, 4))
    lossy = _pair(_at(content, 26, 2, True).bitwiseAND(F.lit(0x3FFF)), _at(content, 28, 2, True).bitwiseAND(F.lit(0x3FFF)))
    bits = _at(content, 21, 4, True)
    lossless = _pair(bits.bitwiseAND(F.lit(0x3FFF)) + 1, F.shiftright(bits, 14).bitwiseAND(F.lit(0x3FFF)) + 1)
    extended = _pair(_at(content, 24, 3, True) + 1, _at(content, 27, 3, True) + 1)
    nothing = _pair(F.lit(0), F.lit(0))
    webp = (
        F.when((chunk == b"VP8 ".hex().upper()) & (F.hex(F.substring(content, 24, 3)) == "9D012A"), lossy)
        .when((chunk == b"VP8L".hex().upper()) & (F.hex(F.substring(content, 21, 1)) == "2F"), lossless)
        .when(chunk == b"VP8X".hex().upper(), extended).otherwise(nothing)
    )
    png = F.when(F.hex(F.substring(content, 13, 4)) == b"IHDR".hex().upper(), _pair(_at(content, 16, 4), _at(content, 20, 4))).otherwise(nothing)
    return (
        F.when(kind == "jpeg", jpeg)
        .when(kind == "png", png).when(kind == "gif", _pair(_at(content, 6, 2, True), _at(content, 8, 2, True))).when(kind == "webp", webp).otherwise(nothing)
    )
