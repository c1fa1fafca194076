import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfspark.functions import pixels
from shelfspark.functions.hashes import informative


def plain(picture):
    """The four words by sums over single pixels."""
    h, w = picture.shape
    grid = [[0.0] * 32 for _ in range(32)]
    for r in range(32):
        for c in range(32):
            area = 0.0
            for y in range(h):
                dy = min((r + 1) * h / 32, y + 1) - max(r * h / 32, y)
                for x in range(w) if dy > 0 else ():
                    dx = min((c + 1) * w / 32, x + 1) - max(c * w / 32, x)
                    if dx > 0:
                        area += dx * dy * float(picture[y, x])
            grid[r][c] = area / (h * w / 1024)
    cos = [[math.cos(math.pi / 32 * (i + 0.5) * k) for i in range(32)] for k in range(16)]
    cols = [[sum(grid[r][c] * cos[v][c] for c in range(32)) for v in range(16)] for r in range(32)]
    values = [round(sum(cols[r][v] * cos[u][r] for r in range(32)), 6) for u in range(16) for v in range(16)]
    mid = sorted(values)
    mid = (mid[127] + mid[128]) / 2
    out = []
    for k in range(4):
        word = sum(1 << b for b in range(64) if values[64 * k + b] >= mid)
        out.append(word - (1 << 64) if word >> 63 else word)
    return out


def distance(a, b):
    return sum(((int(x) ^ int(y)) & ((1 << 64) - 1)).bit_count() for x, y in zip(a, b))


def smooth(rng, h, w):
    y, x = np.mgrid[0:h, 0:w]
    out = sum(rng.normal() / (1 + a + b) * np.cos(math.pi * (a * (y + 0.5) / h + rng.normal())) * np.cos(math.pi * (b * (x + 0.5) / w + rng.normal())) for a in range(14) for b in range(14))
    return (255 * (out - out.min()) / (out.max() - out.min())).astype(np.uint8)


@pytest.mark.parametrize("h,w", [(32, 32), (1, 1), (3, 50), (65, 33), (16, 64)])
def test_against_sums_over_pixels(h, w):
    picture = np.random.default_rng(h * w).integers(0, 256, (h, w)).astype(np.uint8)
    assert pixels.words(pixels.spectrum(picture[None]))[0].tolist() == plain(picture)


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 1 << 30))
def test_small_changes_stay_near_and_others_far(seed):
    rng = np.random.default_rng(seed)
    one, other = smooth(rng, 96, 128), smooth(rng, 96, 128)
    half = one.reshape(48, 2, 64, 2).mean(axis=(1, 3)).astype(np.uint8)
    noisy = np.clip(one.astype(int) + rng.integers(-2, 3, one.shape), 0, 255).astype(np.uint8)
    a, b, c, d = (pixels.words(pixels.spectrum(p[None]))[0] for p in (one, half, noisy, other))
    assert distance(a, b) <= 12 and distance(a, c) <= 12 and distance(a, d) > 60


def test_rows(spark):
    rng = np.random.default_rng(1)
    made = [rng.integers(0, 256, shape).astype(np.uint8) for shape in ((8, 8), (40, 30), (8, 8), (1, 3000))]
    rows = [[n, p.tobytes(), p.shape[1], p.shape[0]] for n, p in enumerate(made)]
    bad = [[10, None, 2, 2], [11, b"abc", 2, 2], [12, b"", 0, 0], [13, b"abcd", None, 2], [14, b"abcd", -2, -2]]
    df = spark.createDataFrame(rows + bad, "n int, pixels binary, width int, height int").repartition(2)
    got = {r["n"]: list(r["h"]) if r["h"] else None for r in df.select("n", pixels.perceptual_hash(df["pixels"], df["width"], df["height"]).alias("h")).collect()}
    assert [got[n] for n in range(4)] == [plain(p) for p in made]
    assert all(got[n] in (None, [None] * 4) for n in range(10, 15))
    assert df.limit(0).select(pixels.perceptual_hash(df["pixels"], df["width"], df["height"])).collect() == []


def test_flat_pictures_say_nothing(spark):
    rows = [[n, bytes([v]) * (h * w), w, h] for n, (v, h, w) in enumerate([(7, 32, 32), (0, 5, 900), (255, 1, 1)])]
    df = spark.createDataFrame(rows, "n int, pixels binary, width int, height int")
    hashed = df.select(pixels.perceptual_hash(df["pixels"], df["width"], df["height"]).alias("h")).select("h.*")
    assert hashed.where(informative()).count() == 0
