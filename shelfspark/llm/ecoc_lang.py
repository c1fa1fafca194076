"""Language ID by error-correcting output codes: linear classifiers over hashed byte n-grams each predict one bit of a language's codeword."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, blobs, crc_of_id, plain_names, sliced, table

#: Hashed n-gram features of each length.
DIM = 1 << 12
#: Labelled rows for the fit at most, as many of each language, the first by a hash of their id; bounds the driver's memory (rows x 3 x DIM floats).
TRAIN_ROWS = 4_000
#: Languages learned at most, the most frequent, by name on ties; rarer ones give no training row and are never predicted. Bounds the driver's memory and the codewords.
LANGS = 1_000
#: Texts whose best and second best languages are nearer than this are flagged as ambiguous.
MARGIN = 0.1
#: Bytes of a text whose n-grams are held at once.
_PIECE = 1 << 20
_LETTER = regex.compile(r"\p{L}")
_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_NOISE = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1: all splits of up to 7 classes (the exhaustive code), else random columns, at least 15 log2 n of them, no two alike."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        cols = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(cols, dtype=np.float64).T
    rng, cols = np.random.default_rng(n), set()
    while len(cols) < int(15 * np.log2(n)):
        c = rng.choice((-1, 1), n)
        if abs(c.sum()) < n:
            cols.add(tuple(c * c[0]))
    return np.array(sorted(cols), dtype=np.float64).T


def grams(data: bytes) -> np.ndarray:
    """Hashed places of the 2-, 3- and 4-grams of a text's bytes; A-Z lowered, runs of ASCII that isn't a letter as one space."""
    a = np.frombuffer(b" " + _NOISE.sub(b" ", data.translate(_UPPER)) + b" ", dtype=np.uint8).astype(np.uint32)
    two = a[:-1] << 8 | a[1:]
    three = two[:-1] << 8 | a[2:]
    out = [two, three]
    if len(a) > 3:
        out.append(three[:-1] * np.uint32(31) + (a[3:] << 24 | a[3:]))
    mul = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
    shift = np.uint32(32 - (DIM.bit_length() - 1))
    return np.concatenate([((x * m) >> shift) + np.uint32(i * DIM) for i, (x, m) in enumerate(zip(out, mul))])


def counted(data: bytes) -> np.ndarray:
    """How often each n-gram comes in a text, counted piece by piece."""
    return sum(np.bincount(grams(data[k : k + _PIECE]), minlength=3 * DIM) for k in range(0, len(data) or 1, _PIECE))


def _profiles(batches):
    for batch in sliced(batches, 0):
        counts = [zstandard.compress(counted(t).astype(np.int64).tobytes(), 1) for t in blobs(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array(counts, pa.binary()), *batch.columns[1:]], names=["n", "l", "__k"])


class Ecoc:
    """Weights (features x bits) and bias of the bit classifiers, codewords, language names and the fit of the score."""

    def __init__(self, langs: list[str], words: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.langs, self.words, self.weights, self.bias = langs, words, weights, bias

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Of each row and language the mean logistic loss of the bits' margins against the codeword."""
        return np.stack([np.logaddexp(0, -margins * w).mean(axis=1) for w in self.words], axis=1)

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, ambiguous): the nearest codeword, a softmax of the losses, the margin to the next."""
        loss = self.losses(margins)
        best = loss.argmin(axis=1)
        soft = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * self.words.shape[1])
        score = soft.max(axis=1) / soft.sum(axis=1)
        if len(self.langs) < 2:
            return best, score, np.zeros(len(best), dtype=bool)
        two = np.sort(loss, axis=1)[:, :2]
        return best, score, two[:, 1] - two[:, 0] < MARGIN

    def margins(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), self.weights.shape[1]))
        for i, t in enumerate(texts):
            g = counted(t)
            at = np.flatnonzero(g)
            x = np.sqrt(g[at] / g.sum()).astype(np.float32)
            out[i] = x @ self.weights[at]
        return out + self.bias


def fit(counts: list[bytes], langs: list[str], rounds: int = 120) -> Ecoc:
    """Logistic regressions over the square roots of relative counts (compressed, of each text), one for each bit, by full-batch gradient steps with momentum; deterministic."""
    names = sorted(set(langs))
    words = codewords(len(names))
    x = np.zeros((len(counts), 3 * DIM), np.float32)
    for i, c in enumerate(counts):
        n = np.frombuffer(zstandard.decompress(c), dtype=np.int64)
        x[i] = np.sqrt(n / n.sum())
    y = words[[names.index(v) for v in langs]].astype(np.float32) if names else np.zeros((0, 1), np.float32)
    # Each language weighs the same.
    share = np.array([1 / langs.count(v) for v in names])
    weight = (share[[names.index(v) for v in langs]] / max(1, len(names))).astype(np.float32)[:, None] if names else np.zeros((0, 1), np.float32)
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        m = (x @ w + b) * y
        g = -y * weight / (1 + np.exp(m))
        vw = 0.9 * vw - 8.0 * (x.T @ g + 1e-6 * w)
        vb = 0.9 * vb - 1.0 * g.sum(axis=0)
        w, b = w + vw, b + vb
    return Ecoc(names, words, w, b)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS, langs: int = LANGS) -> Ecoc:
    """Fit on train_rows labelled rows of docs at most, as many of each language: those of least hash of (id, language).

    Of more than langs languages the rarer ones are left out: their texts get the likest of the others.
    Executors count the n-grams of these rows' whole texts; the driver gets one profile of fixed size for each.
    """
    from pyspark.sql.window import Window

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) > 0))
    key = F.xxhash64(F.col(id_col), F.col(lang_col))
    # A hash bound first thins large tables to a few times the wanted rows; the window then sees only those.
    sizes = {r[lang_col]: r["count"] for r in rows.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(langs).collect()}
    if not sizes:
        return fit([], [])
    rows_per_lang = max(1, train_rows // len(sizes))
    pairs = [x for v, n in sizes.items() for x in (F.lit(v), F.lit(min(1.0, 4 * rows_per_lang / n)))]
    share = F.create_map(*pairs)[F.col(lang_col)]
    thin = rows.where(F.pmod(key, F.lit(1 << 20)) < share * (1 << 20)).withColumn("__k", key)
    few = thin.withColumn("__r", F.row_number().over(Window.partitionBy(lang_col).orderBy("__k", id_col, text_col))).where(F.col("__r") <= rows_per_lang)
    texts = few.select(F.col(text_col).cast("binary").alias("t"), F.col(lang_col).alias("l"), "__k")
    got = sorted(texts.transform(arrow_map, _profiles, "n binary, l string, __k bigint").collect(), key=lambda r: (r["l"], r["__k"], bytes(r["n"])))
    return fit([bytes(r["n"]) for r in got], [r["l"] for r in got])


def predict(docs: DataFrame, model: Ecoc, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """(id, kept columns, lang_pred, score, ambiguous) of every row, from its whole text alone.

    A null text or one without a letter, and every text if nothing could be learned, is `und` with score 0 and not
    ambiguous. Repeated rows get the same answer. Long texts are counted whole; their n-grams are counted piece by piece.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = [id_col, *keep]
    head = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols)

    def run(batches):
        m = shared.value
        for batch in sliced(batches, 0):
            texts = list(blobs(batch.column(0)))
            known = np.array([bool(m.langs) and _LETTER.search(t.decode("utf-8", "replace")) is not None for t in texts], dtype=bool)
            best, score, unsure = m.decide(m.margins([t if k else b"" for t, k in zip(texts, known)])) if m.langs else (np.zeros(len(texts), int), np.zeros(len(texts)), known)
            lang = [m.langs[b] if k else "und" for b, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lang), pa.array(np.where(known, score, 0.0)), pa.array(unsure & known)], names=[*cols, "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col(f"`{text_col}`").cast("binary").alias("__text"), *[F.col(f"`{c}`") for c in cols])
    return rows.transform(arrow_map, run, f"{head}, lang_pred string, score double, ambiguous boolean")


def op5_ecoc_lang(spark, sf_dir: str) -> DataFrame:
    """Language of every document; learned from documents whose crc32(doc_id) mod 3 is not 1."""
    docs = plain_names(table(spark, sf_dir, "documents"), ["doc_id", "text", "lang"])
    held = crc_of_id() % 3 == 1
    model = train(docs.where(~held))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
