"""Column functions over paths, ids, times and bytes."""

from __future__ import annotations

from pyspark.sql import functions as F


def content_id(content, prefix: str = ""):
    """prefix and the first 16 hex digits of the SHA-256: bare for pixels, `b` for bytes, `x` for what can't be decoded."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(content, 256), 1, 16))


def revision(content):
    return F.sha2(content, 256)


def cache_key(path="path"):
    """`p` and 16 hex digits of the path's SHA-256; paths of the source main are taken without it, others with a NUL before them."""
    p = F.col(path)
    plain = F.when(p.startswith("main/"), F.expr(f"substring({path}, 6)")).otherwise(F.concat(F.unhex(F.lit("00")).cast("string"), p))
    return F.concat(F.lit("p"), F.substring(F.sha2(plain, 256), 1, 16))


def utc_minute(seconds):
    """YYYY-MM-DD HH:MMZ of seconds since the epoch, cut to the minute."""
    return F.date_format(F.timestamp_seconds(F.floor(seconds)), "yyyy-MM-dd HH:mm'Z'")


def basename(path):
    return F.element_at(F.split(path, "/"), -1)


def percent_encode(col):
    """Percent-encoding with %20 for blanks; slashes stay."""
    out = F.regexp_replace(F.url_encode(col), r"\+", "%20")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "%2F", "/"), "%7E", "~"), r"\*", "%2A")


def percent_decode(col):
    """The reverse; a plus is a plus."""
    return F.try_url_decode(F.regexp_replace(col, r"\+", "%2B"))


def html_escape(col):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


def media_type(path):
    """The MIME type by extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)\z", 1))
    known = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif", "avif": "image/avif", "mp4": "video/mp4", "webm": "video/webm", "mkv": "video/x-matroska"}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ext), F.lit("application/octet-stream"))


def sniff(content):
    """The container by its first bytes."""
    head = F.hex(F.substring(content, 1, 16))
    at = lambda start, text: F.substring(head, 2 * start + 1, 2 * len(text)) == text.hex().upper()
    return (
        F.when(at(0, b"\xff\xd8\xff"), "jpeg").when(at(0, b"\x89PNG\r\n\x1a\n"), "png").when(at(0, b"RIFF") & at(8, b"WEBP"), "webp").when(at(0, b"GIF8"), "gif")
        .when(at(4, b"ftyp") & (at(8, b"avif") | at(8, b"avis")), "avif").when(at(4, b"ftyp"), "mp4").when(at(0, b"\x1a\x45\xdf\xa3"), "mkv").otherwise("other")
    )


def animated_png(content):
    """Whether a PNG's animation chunk comes before its first image data; the hex form is read at byte boundaries only by its even offsets."""
    digits = F.hex(content)
    control, data = F.instr(digits, b"acTL".hex().upper()), F.instr(digits, b"IDAT".hex().upper())
    return (sniff(content) == "png") & (control > 0) & (control % 2 == 1) & ((data == 0) | (control < data))
