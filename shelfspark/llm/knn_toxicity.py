"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, votes weighted by distance, calibrated, with the examples as evidence."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, blobs, crc_of_id, give_back, plain_names, sliced, table

#: Labelled examples of each class at most, the first by a hash of their id.
EXAMPLES = {1: 2_048, 0: 4_096}
#: Neighbours that vote, and how many of them are named as evidence.
NEIGHBOURS = 15
EVIDENCE = 3
_BLOCK = 64
_COMMON = 32
_AT_ONCE = 128
#: Examples that are scored first, to bound the others.
_LEAD = 256
_STEMS = (5, 7)
#: Word sets with a Jaccard of this much, in hundredths, are near copies.
_SAME = 80
#: Weights of the words that don't go with a label, against 1 for the terms that do; the one of least leave-one-out loss is taken.
BACKGROUND = (0.1, 0.2, 0.4, 0.8)
#: Hashed counts for the documents that hold a word of no example; such words only add to a text's length.
SLOTS = 1 << 20
#: Cosines this near to 1 are those of the same vector.
_EQUAL = 1 - 1e-9
#: Background weight and calibration are fitted on every (n / _TUNED)-th example, in the order of ids.
_TUNED = 1_000
#: Characters and bytes that are worked on at once.
_PIECE = 1 << 18
_SLICE = 2 << 20


class _Hasher:
    """64-bit hashes of the words of texts, and of their beginnings, all at once: sums of a random value for each character times powers of an odd number, taken from running sums."""

    def __init__(self, seed: int = 11):
        n = sys.maxunicode + 1
        self.value = np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)
        self.letter = np.fromiter((c == "_" or c.isalnum() for c in map(chr, range(n))), dtype=bool, count=n)
        self.size = 0

    def _grow(self, n: int) -> None:
        odd = 0x9E3779B97F4A7C15
        self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, p, np.uint64)))) for p in (odd, pow(odd, -1, 1 << 64)))
        self.size = n

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(number of the text, hash) of every lower-case word, and for each of _STEMS the hash of its beginning, 0 where it isn't longer."""
        texts = [t.decode("utf-8", "replace").lower() for t in texts]
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        chars = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        out, at = [], 0
        while at < len(chars):
            a = chars[at : at + _PIECE]
            if at + len(a) < len(chars):  # cut between words
                gaps = np.flatnonzero(~self.letter[a[-(1 << 10) :]])
                gaps = gaps + max(0, len(a) - (1 << 10)) if len(gaps) else np.flatnonzero(~self.letter[a])
                if not len(gaps):  # a longer word
                    gaps = np.flatnonzero(~self.letter[chars[at:]])
                a = chars[at : at + (int(gaps[-1 if gaps[-1] < len(a) else 0]) + 1 if len(gaps) else len(chars))]
            if len(a) > self.size:
                self._grow(max(_PIECE, 2 * len(a)))
            ink = self.letter[a]
            edge = np.flatnonzero(ink[1:] != ink[:-1]) + 1
            edge = np.concatenate((np.zeros(int(ink[0]), np.int64), edge, np.full(int(ink[-1]), len(a), np.int64)))
            start, end = edge[::2], edge[1::2]
            run = np.zeros(len(a) + 1, dtype=np.uint64)
            np.cumsum(self.value[a] * self.up[: len(a)], out=run[1:])
            stems = []
            for n in _STEMS:
                stem = _mix(((run[np.minimum(start + n, len(a))] - run[start]) * self.down[start]) ^ np.uint64(n))
                stems.append(np.where(end - start > n, stem, np.uint64(0)))
            out.append((np.searchsorted(ends, start + at, "right"), (run[end] - run[start]) * self.down[start], *stems))
            at += len(a)
        if not out:
            z = np.zeros(0, np.uint64)
            return z.astype(np.int64), z, [z for _ in _STEMS]
        of, words, *stems = (np.concatenate(x) for x in zip(*out))
        return of, words, stems


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_HASHERS: list[_Hasher] = []


def hasher() -> _Hasher:
    """One for each process."""
    if not _HASHERS:
        _HASHERS.append(_Hasher())
    return _HASHERS[0]


def example_words(texts: list[bytes]) -> list[np.ndarray]:
    """Of each text a row for each distinct word, by hash: its hash, those of its beginnings (0: none) and how often it comes."""
    of, words, stems = hasher().words(texts)
    cuts, out = np.searchsorted(of, np.arange(len(texts) + 1)), []
    for s, e in zip(cuts, cuts[1:]):
        own, at, n = np.unique(words[s:e], return_index=True, return_counts=True)
        out.append(np.stack([own, *[x[s:e][at] for x in stems], n.astype(np.uint64)], axis=1))
    return out


def distinct(words: list[np.ndarray], labels: list[int]) -> list[int]:
    """Numbers of the word sets (sorted hashes) that aren't near copies of an earlier one of these with the same label.

    Sets as near as _SAME share a word among their rarest (100 - _SAME) hundredths, so only those meet.
    """
    every, at = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]), return_inverse=True)
    held, out, by, first = np.bincount(at, minlength=len(every)), [], {}, 0
    for i, (s, y) in enumerate(zip(words, labels)):
        own = at[first : first + len(s)]
        first += len(s)
        rare = own[np.lexsort((own, held[own]))][: len(s) * (100 - _SAME) // 100 + 1].tolist() or [-1]
        met = {j for w in rare for j in by.get((y, w), ()) if 100 * min(len(s), len(words[j])) >= _SAME * max(len(s), len(words[j]))}
        if not any((100 + _SAME) * len(np.intersect1d(s, words[j], assume_unique=True)) >= _SAME * (len(s) + len(words[j])) for j in met):
            out.append(i)
            for w in rare:
                by.setdefault((y, w), []).append(i)
    return out


def chosen_terms(examples: list[np.ndarray], labels: list[int]) -> np.ndarray:
    """Hashes of the terms (words and their beginnings) that go with a label: chi-square of 2 ln(number of terms) or more over texts that aren't near copies."""
    kept = distinct([x[:, 0] for x in examples], labels)  # near copies would give chance words weight
    held = [np.unique(x[:, :-1][x[:, :-1] > 0]) for x in (examples[i] for i in kept)]
    size = np.bincount([labels[i] for i in kept], minlength=2)
    terms, at = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_inverse=True)
    label = np.repeat([labels[i] for i in kept], [len(x) for x in held]).astype(bool)
    a, c = (np.bincount(at[k], minlength=len(terms)).astype(float) for k in (label, ~label))
    n1, n0 = float(size[1]), float(size[0])
    b, d = n1 - a, n0 - c
    bound, under = 2 * math.log(int((a > 0).sum() + (c > 0).sum()) + 2), (a + b) * (c + d) * (a + c) * (b + d)
    with np.errstate(divide="ignore", invalid="ignore"):
        return terms[(a + c > 1) & (under > 0) & ((a + b + c + d) * (a * d - b * c) ** 2 / under >= bound)]


class Terms:
    """Numbers of terms: a known one's place among the sorted hashes; any other word has its slot after them all."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self._derived()

    def _derived(self) -> None:
        bits = max(4, (2 * len(self.hashes)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def __len__(self) -> int:
        return len(self.hashes)

    def __getstate__(self):
        return self.hashes

    def __setstate__(self, state):
        self.hashes = state
        self._derived()

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The places of hashes among the known ones, -1 for others."""
        out = np.full(len(words), -1, dtype=np.int64)
        todo = np.flatnonzero(words > 0)
        place = self.start[(words[todo] >> self.shift).astype(np.int64)].astype(np.int64)
        while len(todo):
            there = place < len(self.hashes)
            todo, place = todo[there], place[there]
            known, asked = self.hashes[place], words[todo]
            hit = known == asked
            out[todo[hit]] = place[hit]
            on = known < asked
            todo, place = todo[on], place[on] + 1
        return out

    def keys(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the text << 32 | number of the term, in order, and how often each comes."""
        of, words, stems = hasher().words(texts)
        own, at, which = np.unique(words, return_index=True, return_inverse=True)
        number = self.numbers(own)
        number = np.where(number < 0, len(self.hashes) + (own % np.uint64(SLOTS)).astype(np.int64), number)
        found = [(of << 32) | number[which]]
        for stem in stems:
            number = self.numbers(stem[at])
            if (number >= 0).any():
                number = number[which]
                found.append((of[number >= 0] << 32) | number[number >= 0])
        return np.unique(np.concatenate(found), return_counts=True)

    def of(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text the numbers of its terms, in order, and how often each comes."""
        keys, n = self.keys(texts)
        cuts = np.searchsorted(keys, np.arange(len(texts) + 1) << 32)
        return [(keys[s:e] & 0xFFFFFFFF, n[s:e]) for s, e in zip(cuts, cuts[1:])]


def doc_frequencies(docs: DataFrame, terms: Terms, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Documents that hold each term, then those that hold the words of each slot, and documents with a text, over the whole table; a task sends one array of that length."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    n = len(terms) + SLOTS + 1

    def count(batches):
        total = np.zeros(n, dtype=np.int64)
        for batch in sliced(batches, 0, _SLICE):
            texts = [t for t in blobs(batch.column(0)) if t]
            total[:-1] += np.bincount(shared.value.keys(texts)[0] & 0xFFFFFFFF, minlength=n - 1)
            total[-1] += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())], names=["k", "n"])

    def add(batches):
        total = np.zeros(n, dtype=np.int64)
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                total += np.frombuffer(zstandard.decompress(blob), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())], names=["k", "n"])

    total = np.zeros(n, dtype=np.int64)
    parts = docs.select(F.col(f"`{text_col}`").cast("binary").alias("text")).transform(arrow_map, count, "k int, n binary")
    for r in parts.repartition(8).transform(arrow_map, add, "k int, n binary").collect():
        total += np.frombuffer(zstandard.decompress(bytes(r["n"])), dtype=np.int64)
    return total[:-1], int(total[-1])


class BlockMaxIndex:
    """Postings of unit vectors by term, cut into blocks of examples; of each term and block that meet the greatest weight is kept.

    Terms of a _COMMON-th of the examples or more stand in a matrix instead and are multiplied for many queries at once.
    search() bounds every block by its best common part plus the query's weights times the maxima of its other terms,
    scores the most promising blocks in full and then only those whose bound reaches the k-th best score, so its answer
    is that of a full scan. Cosines are rounded to 12 digits, so that equal examples tie.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = _BLOCK):
        self.n, self.terms, self.block = len(vectors), terms, block
        # Examples with the same heaviest term stand together, which makes the bounds of a block tight.
        heavy = np.array([t[w.argmax()] if len(t) else terms for t, w in vectors], dtype=np.int64)
        self.order = np.argsort(heavy, kind="stable")
        self.blocks = -(-self.n // block) if self.n else 0
        term = np.concatenate([vectors[i][0] for i in self.order] or [np.zeros(0, np.int64)]).astype(np.int32)
        weight = np.concatenate([vectors[i][1] for i in self.order] or [np.zeros(0)])
        place = np.repeat(np.arange(self.n, dtype=np.int32), [len(vectors[i][0]) for i in self.order])
        by = np.argsort(term, kind="stable").astype(np.int32)  # places rise within a term
        self.place, self.weight, term = place[by], weight[by], term[by]
        del place, weight, by
        held = np.bincount(term, minlength=terms)
        self.row = np.where(held * _COMMON >= max(1, self.n), np.cumsum(held * _COMMON >= max(1, self.n)) - 1, -1)
        common = self.row[term] >= 0 if len(term) else np.zeros(0, dtype=bool)
        self.filled = self.row[term[common]].astype(np.int32), self.place[common].astype(np.int32), self.weight[common]
        self.place, self.weight, term = self.place[~common].astype(np.int32), self.weight[~common], term[~common]
        # A cell is a term and a block that meet; its postings stand together, as do the cells of a term.
        cell = term.astype(np.int64) * max(1, self.blocks) + self.place // block
        start = np.flatnonzero(np.diff(cell, prepend=-1))
        cells = cell[start]
        self.start = np.append(start, len(term)).astype(np.int32)
        self.first = np.searchsorted(cells // max(1, self.blocks), np.arange(terms + 1)).astype(np.int32)
        self._derived()

    def _derived(self) -> None:
        """What follows from the postings and doesn't travel with them: the matrix, and each cell's block and greatest weight."""
        start, (row, place, weight) = self.start[:-1], self.filled
        self.matrix = np.zeros((int(self.row.max(initial=-1)) + 1, self.blocks * self.block))
        self.matrix[row, place] = weight
        self.most = np.maximum.reduceat(self.weight, start) if len(start) else np.zeros(0)
        self.in_block = self.place[start] // np.int32(self.block)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("matrix", "most", "in_block")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._derived()

    def _score(self, cells: np.ndarray, weights: np.ndarray) -> np.ndarray:
        n = self.start[cells + 1] - self.start[cells]
        at = _runs(self.start[cells], n)
        return np.bincount(self.place[at], self.weight[at] * np.repeat(weights, n), self.blocks * self.block)

    def common(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the common terms add to the cosine of each vector and place."""
        asked = np.zeros((len(vectors), len(self.matrix)))
        for i, (terms, weights) in enumerate(vectors):
            row = self.row[terms[terms < self.terms]]
            asked[i, row[row >= 0]] = weights[: len(row)][row >= 0]
        return asked @ self.matrix

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int | None = None, common: np.ndarray | None = None) -> list[tuple[float, int]]:
        """(cosine, example) of the k best with a cosine above 0, best first, the lower number on ties; terms, in order, beyond the index's own meet no example."""
        if not len(terms) or not self.n:
            return []
        base = self.common([(terms, weights)])[0] if common is None else common
        known = int(np.searchsorted(terms, self.terms))
        terms, weights = terms[:known], weights[:known]
        n = self.first[terms + 1] - self.first[terms]
        cells, weights = _runs(self.first[terms], n), np.repeat(weights, n)
        block = self.in_block[cells]
        bound = np.bincount(block, weights * self.most[cells], self.blocks) + base.reshape(self.blocks, self.block).max(axis=1)
        lead = min(self.blocks, max(1, _LEAD // self.block, -(-2 * k // self.block)))
        first = np.zeros(self.blocks, dtype=bool)
        first[np.argpartition(-bound, lead - 1)[:lead]] = True
        held = first[block]
        scores = self._score(cells[held], weights[held]) + base
        own = None if skip is None else int(np.flatnonzero(self.order == skip)[0])
        if own is not None:
            scores[own] = -1.0
        led = scores.reshape(self.blocks, self.block)[first].ravel()
        kth = np.partition(led, -k)[-k] if len(led) >= k else 0.0
        rest = ~first & (bound >= kth - 1e-9) & (bound > 0)
        if rest.any():
            held = rest[block]
            scores += self._score(cells[held], weights[held])
            if own is not None:
                scores[own] = -1.0
        scores.reshape(self.blocks, self.block)[~(first | rest)] = 0.0
        at = np.flatnonzero(scores > max(0.0, kth - 1e-9))
        found = scores[at].round(12)
        if len(at) > 4 * k:
            near = found >= np.partition(found, -k)[-k]
            at, found = at[near], found[near]
        best = sorted((-v, i) for v, i in zip(found.tolist(), self.order[at].tolist()) if v > 0)[:k]
        return [(-v, i) for v, i in best]


def _runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each start on, n of each, one run after the other."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def counted(rows: DataFrame) -> DataFrame:
    """(__id, __y, words) of (__id, __y, t): example_words of each whole text, compressed."""
    kind = rows.schema["__id"].dataType.simpleString()

    def run(batches):
        for batch in sliced(batches, 2, _SLICE):
            found = [zstandard.compress(x.tobytes(), 1) for x in example_words(list(blobs(batch.column(2))))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["__id", "__y", "words"])

    return rows.transform(arrow_map, run, f"__id {kind}, __y int, words binary")


class ToxicModel:
    """Terms with their inverse document frequencies, the index of examples, and the calibration of the vote."""

    def __init__(self, known: Terms, idf: np.ndarray, chosen: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray]], labels: list[int], ids: list, share: float):
        self.known = known
        self.labels, self.ids = np.array(labels, dtype=np.int64), ids
        marked = np.zeros(len(idf), dtype=bool)
        marked[known.numbers(chosen)] = True
        tried = range(0, len(counts), max(1, len(counts) // _TUNED))
        best = None
        for weight in BACKGROUND:
            self._indexed(np.where(marked, idf, idf * weight), counts)
            votes = np.array([self.vote(self.index.search(*self.weighted(*counts[i]), NEIGHBOURS, skip=i)) for i in tried])
            fit = _logistic(votes, self.labels[list(tried)])
            z = (fit[0] * votes + fit[1]) * (2 * self.labels[list(tried)] - 1)
            loss = float(np.logaddexp(0, -z).mean()) if len(z) else 0.0
            if best is None or loss < best[0]:
                best = (loss, weight, fit)
        _, weight, (self.slope, self.offset) = best
        self._indexed(np.where(marked, idf, idf * weight), counts)
        if 0 < self.labels.sum() < len(labels) and 0 < share < 1:  # from the sample's share of toxic rows to that of all labelled rows
            own = self.labels.mean()
            self.offset += math.log(share / (1 - share)) - math.log(own / (1 - own))

    def _indexed(self, idf: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.index = None  # one index at a time
        give_back()
        self.idf = idf
        self.index = BlockMaxIndex([self.weighted(*c) for c in counts], len(self.known))

    def weighted(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and weights (1 + ln tf) idf, of length 1; empty without a word."""
        weights = (1 + np.log(counts)) * self.idf[terms]
        norm = np.sqrt((weights * weights).sum())
        return (terms, weights / norm) if norm > 0 else (terms[:0], weights[:0])

    def vectors(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [self.weighted(*c) for c in self.known.of(texts)]

    def nearest(self, texts: list[bytes]) -> list[list[tuple[float, int]]]:
        """The neighbours of each text."""
        out = []
        for k in range(0, len(texts), _AT_ONCE):
            vectors = self.vectors(texts[k : k + _AT_ONCE])
            out += [self.index.search(*v, NEIGHBOURS, common=c) for v, c in zip(vectors, self.index.common(vectors))]
        return out

    def vote(self, found: list[tuple[float, int]]) -> float:
        """Share of toxic among the neighbours, each weighted by 1 / (distance + 0.1); examples of the same vector, if any, vote alone."""
        if not found:
            return 0.0
        if found[0][0] >= _EQUAL:
            found = [(s, i) for s, i in found if s >= _EQUAL]
        weight = np.array([1 / (1.1 - min(1.0, s)) for s, _ in found])
        return float((weight * self.labels[[i for _, i in found]]).sum() / weight.sum())

    def score(self, found: list[tuple[float, int]]) -> float:
        z = self.slope * self.vote(found) + self.offset
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a ridge logistic fit in one variable, by Newton steps; without both classes a flat fit."""
    n = len(y)
    if not n or y.min() == y.max():
        share = (y.sum() + 0.5) / (n + 1)
        return 0.0, math.log(share / (1 - share))
    a = np.stack([x, np.ones(n)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(h, a.T @ (y - p) - np.array([1e-2 * w[0], 0]))
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicModel:
    """Examples: of each class the EXAMPLES rows of least id hash among those with a label of 0 or 1 and a text; statistics of terms come from all documents."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    sizes = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    key = F.xxhash64("__id")
    share = F.when(F.col("__y") == 1, F.lit(min(1.0, 4 * EXAMPLES[1] / max(1, sizes.get(1, 0))))).otherwise(F.lit(min(1.0, 4 * EXAMPLES[0] / max(1, sizes.get(0, 0)))))
    thin = known.where(F.pmod(key, F.lit(1 << 20)) < share * (1 << 20)).withColumn("__k", key)
    most = F.when(F.col("__y") == 1, EXAMPLES[1]).otherwise(EXAMPLES[0])
    few = thin.withColumn("__r", F.row_number().over(Window.partitionBy("__y").orderBy("__k", "__id"))).where(F.col("__r") <= most)
    # The chosen ids are at most EXAMPLES in number, so they can be broadcast.
    rows = docs.where(F.col(text_col).isNotNull()).join(F.broadcast(few), F.col(id_col) == F.col("__id"))
    got = counted(rows.select("__id", "__y", F.col(f"`{text_col}`").cast("binary").alias("t")).dropDuplicates(["__id"])).orderBy("__id").collect()
    ys, ids = [r["__y"] for r in got], [r["__id"] for r in got]
    examples = [np.frombuffer(zstandard.decompress(bytes(r["words"])), dtype=np.uint64).reshape(-1, len(_STEMS) + 2) for r in got]
    del got
    chosen = chosen_terms(examples, ys)
    known = Terms(np.unique(np.concatenate([chosen, *[x[:, 0] for x in examples]])))
    counts = []
    for k, x in enumerate(examples):
        number, n = known.numbers(x[:, :-1].T.ravel()), np.tile(x[:, -1].astype(np.int64), len(_STEMS) + 1)
        at, first = np.unique(number[number >= 0], return_inverse=True)
        counts.append((at, np.bincount(first, n[number >= 0], len(at)).astype(np.int64)))
        examples[k] = None
    del examples
    give_back()
    df, n = doc_frequencies(docs, known, text_col)
    idf = np.log((1 + n) / (1 + df)) + 0.01
    return ToxicModel(known, idf, chosen, counts, ys, ids, sizes.get(1, 0) / max(1, sum(sizes.values())))


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, evidence, evidence_cosine) of every row, from its whole text alone.

    A null or empty text, or one without a word of an example, has no neighbour: its score is that of no vote. Ties between
    examples go to the lower example number; repeated rows score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        m = shared.value
        for batch in sliced(batches, 1, _SLICE):
            found = m.nearest(list(blobs(batch.column(1))))
            s = np.array([m.score(f) for f in found], dtype=np.float64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array([[int(m.ids[i]) for _, i in f[:EVIDENCE]] for f in found], pa.list_(pa.int64())),
                    pa.array([[float(c) for c, _ in f[:EVIDENCE]] for f in found], pa.list_(pa.float64())),
                ],
                names=[id_col, "score", "predicted", "evidence", "evidence_cosine"],
            )

    cols = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("binary").alias("__text"))
    return cols.transform(arrow_map, run, f"`{id_col}` {kind}, score double, predicted int, evidence array<bigint>, evidence_cosine array<double>")


def op6_knn_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned from labels whose crc32(doc_id) mod 5 is not 0."""
    docs = plain_names(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    labels = plain_names(table(spark, sf_dir, "labels"), ["doc_id", "toxic"]).where(crc_of_id() % 5 != 0)
    return score(docs, train(docs, labels)).select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "score", "predicted", "evidence", "evidence_cosine")
