import struct

from shelfspark.functions.headers import dimensions
from shelfspark.sources import files


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h) + b"\x08\x02\0\0\0" + b"IDAT"


def gif(w, h):
    return b"GIF89a" + struct.pack("<HH", w, h) + b"\0\0\0"


def webp(chunk, body):
    return b"RIFF" + struct.pack("<I", len(body) + 12) + b"WEBP" + chunk + struct.pack("<I", len(body)) + body


def jpeg(w, h, *segments, mark=0xC0):
    parts = [b"\xff\xd8"] + [b"\xff" + bytes([m]) + struct.pack(">H", len(b) + 2) + b for m, b in segments]
    return b"".join(parts) + b"\xff" + bytes([mark]) + struct.pack(">HBHHB", 17, 8, h, w, 3) + b"\0" * 9 + b"\xff\xda\0\x0c"


CASES = [
    (png(640, 480), (640, 480)), (png(70_000, 1), (70_000, 1)), (png(5, 6)[:20], (0, 0)), (gif(7, 65_535), (7, 65_535)),
    (webp(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 300 | 1 << 14, 200 | 2 << 14)), (300, 200)),
    (webp(b"VP8L", b"\x2f" + struct.pack("<I", (800 - 1) | (600 - 1) << 14 | 1 << 28)), (800, 600)),
    (webp(b"VP8X", b"\x10\0\0\0" + (99_999).to_bytes(3, "little") + (1).to_bytes(3, "little")), (100_000, 2)),
    (webp(b"ALPH", b"\0" * 20), (0, 0)),
    (jpeg(1920, 1080), (1920, 1080)),
    # a frame header inside an APP segment (a thumbnail's) doesn't count, nor do tables whose marks lie between the frames'
    (jpeg(31, 32, (0xE1, b"Exif" + jpeg(160, 120)), (0xC4, b"\xff\xc0\0\x11\x08" * 3), (0xDB, b"\0" * 65_533), mark=0xC2), (31, 32)),
    (jpeg(9, 8, *[(0xE2, b"")] * 5_000), (9, 8)),
    (b"\xff\xd8\xff\xff\xff\xff" + jpeg(3, 4)[3:], (3, 4)), (b"\xff\xd8\xff\x01\xff\xd0" + jpeg(3, 4)[2:], (3, 4)),
    (b"\xff\xd8\xff\xe0\0\0" + jpeg(3, 4), (0, 0)), (jpeg(3, 4)[:9], (0, 0)), (b"\xff\xd8\xff", (0, 0)), (jpeg(3, 4, mark=0xDA), (0, 0)),
    (b"", (0, 0)), (b"text", (0, 0)), (None, (0, 0)),
]


def test_dimensions(spark):
    rows = spark.createDataFrame([[n, b] for n, (b, _) in enumerate(CASES)], "n int, content binary")
    got = {r["n"]: (r["d"]["width"], r["d"]["height"]) for r in rows.select("n", dimensions(rows["content"]).alias("d")).collect()}
    assert got == {n: size for n, (_, size) in enumerate(CASES)}


def test_a_scanned_folder_can_be_searched_by_width(spark, tmp_path):
    from shelfspark.plans.catalog import Catalog
    from shelfspark.schema import TABLES, empty

    for name, data in (("a.png", png(640, 480)), ("b.jpg", jpeg(1920, 1080, (0xE0, b"JFIF\0"))), ("c.txt", b"text")):
        (tmp_path / name).write_bytes(data)
    tables = {t: empty(spark, t) for t in TABLES} | {"files": files.scan(spark, str(tmp_path)).drop("xmp_tags", "folder_tags", "text", "manual")}
    found = lambda q: sorted(r["path"] for r in Catalog(spark, tables).search(q, lambda t: t, columns=["path"]).collect())
    assert found("width.gt:1000") == ["main/b.jpg"] and found("height:480") == ["main/a.png"] and found("width:0") == ["main/c.txt"]
