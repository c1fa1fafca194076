"""Byte-level BPE encoding and decoding with a hierarchical-bitmap queue of merge ranks."""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, blobs, plain_names, sliced, table

#: Pre-tokens whose ids a worker remembers, and the longest that it does: bounds its memory, changes no result.
REMEMBERED = 1 << 19
_LONGEST = 64
#: Pre-tokens that are merged side by side.
_SIDE = 1 << 17
#: Bytes of text that a worker encodes at once.
_SLICE = 8 << 20

# White space of the Unicode property, and of U+0000 to U+00FF the characters of the classes L and N.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LATIN_L = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
_LATIN_N = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"


@lru_cache(maxsize=8)
def _splitters(pattern: str):
    """The pattern for any text, and for texts of Latin-1 characters the same with its classes written out, which is quicker."""
    spelled = pattern.replace("[^\\s", f"[^{_SPACE}").replace("\\s", f"[{_SPACE}]").replace("\\S", f"[^{_SPACE}]")
    latin = spelled.replace("[^" + _SPACE + "\\p{L}\\p{N}]", f"[^{_SPACE}{_LATIN_L}{_LATIN_N}]").replace("\\p{L}", f"[{_LATIN_L}]").replace("\\p{N}", f"[{_LATIN_N}]")
    return regex.compile(spelled), None if "\\p" in latin else re.compile(latin)


def pre_tokens(text: str, pattern: str = public_tokenizers.PATTERN) -> list[str]:
    """The matches of the pattern, in order."""
    general, latin = _splitters(pattern)
    if latin is None or not (text.isascii() or _is_latin(text)):
        return [m.group() for m in general.finditer(text)]
    return latin.findall(text)


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class RankQueue:
    """Positions by merge rank. Bitmaps of three levels mark the ranks whose bucket holds a position; find-first-set walks down from the top, so the least rank comes in three steps however many wait."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, at)
            return
        self.buckets[rank] = [at]
        self.mark(rank)

    def mark(self, rank: int) -> None:
        word, page = rank >> 6, rank >> 12
        self.low[word] |= 1 << (rank & 63)
        self.mid[page] |= 1 << (word & 63)
        self.top |= 1 << page

    def least(self) -> int:
        """The least rank with a position, or -1."""
        top = self.top
        if not top:
            return -1
        page = (top & -top).bit_length() - 1
        mid = self.mid[page]
        word = page << 6 | (mid & -mid).bit_length() - 1
        low = self.low[word]
        return word << 6 | (low & -low).bit_length() - 1

    def take(self, rank: int) -> int:
        """The leftmost position of the rank's bucket; an emptied bucket leaves the bitmaps."""
        bucket = self.buckets[rank]
        at = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.clear(rank)
        return at

    def clear(self, rank: int) -> None:
        word, page = rank >> 6, rank >> 12
        self.low[word] &= ~(1 << (rank & 63))
        if not self.low[word]:
            self.mid[page] &= ~(1 << (word & 63))
            if not self.mid[page]:
                self.top &= ~(1 << page)


class Bpe:
    """Ranks of byte strings; every single byte must have one. An id is a rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks, self.pattern = ranks, pattern
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.top = max(ranks.values())
        self.queue = RankQueue(self.top)
        self.pairs = self.joined = None
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the adjacent pair of least rank, leftmost first, is joined until none has a rank."""
        ranks, queue, n = self.ranks, self.queue, len(piece)
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at = [ranks.get(piece[i : i + 2], -1) for i in range(n - 1)]
        rank_at.append(-1)
        for i, r in enumerate(rank_at):
            if r >= 0:
                queue.push(r, i)
        longest = self.longest
        while (r := queue.least()) >= 0:
            i = queue.take(r)
            if rank_at[i] != r:  # stale: one of its two parts has been joined to another
                continue
            j = after[i]
            k = after[j]
            after[i] = k
            rank_at[j] = -1
            new = -1
            if k < n:
                before[k] = i
                end = after[k]
                if end - i <= longest:
                    new = ranks.get(piece[i:end], -1)
            rank_at[i] = new
            if new >= 0:
                queue.push(new, i)
            p = before[i]
            if p >= 0:
                new = ranks.get(piece[p:k], -1) if k - p <= longest else -1
                rank_at[p] = new
                if new >= 0:
                    queue.push(new, p)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def _tables(self) -> None:
        """Of every rank's bytes all ways to cut them in two that have ranks: keys (left << 20 | right), sorted, and what they join to."""
        ranks = self.ranks
        found = [(ranks[b[:k]] << 20 | ranks[b[k:]], r) for b, r in ranks.items() for k in range(1, len(b)) if b[:k] in ranks and b[k:] in ranks]
        found.sort()
        self.pairs = np.array([k for k, _ in found], dtype=np.int64)
        self.joined = np.array([r for _, r in found], dtype=np.int64)
        self.single = np.array([self.ranks[bytes([c])] for c in range(256)], dtype=np.int64)

    def _join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.joined[at], -1)

    def merge_many(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """merge() of many pre-tokens side by side, in one linked list with a stop after each.

        The same queue holds arrays of positions: a step takes the least rank's whole bucket, drops the stale ones,
        joins the leftmost of each pre-token and puts the others back, so every pre-token sees its merges in the order
        of merge().
        """
        if not len(self.ranks):
            return [() for _ in words]
        if self.pairs is None:
            self._tables()
        stop = (1 << 20) - 1  # no rank, so a pair with it has none
        data = np.frombuffer(b"\0".join(words) + b"\0", dtype=np.uint8)
        ends = np.cumsum(np.array([len(w) + 1 for w in words])) - 1
        n = len(data)
        token = self.single[data]
        token[ends] = stop
        word = np.zeros(n, dtype=np.int64)
        word[ends[:-1] + 1] = 1
        word = np.cumsum(word)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank_at = np.full(n, -1, dtype=np.int64)
        rank_at[:-1] = self._join(token[:-1], token[1:])
        queue = RankQueue(self.top)
        buckets = queue.buckets
        first = np.flatnonzero(rank_at >= 0)
        first = first[np.argsort(rank_at[first], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank_at[first])) + 1
        for part in np.split(first, cuts) if len(first) else ():
            queue.mark(int(rank_at[part[0]]))
            buckets[int(rank_at[part[0]])] = [part]
        while (r := queue.least()) >= 0:
            parts = buckets.pop(r)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[rank_at[at] == r]
            queue.clear(r)
            if not len(at):
                continue
            if len(at) > 1:
                w = word[at]
                again = w[1:] == w[:-1]
                if again.any():
                    again = np.concatenate(([False], again))
                    buckets[r] = [at[again]]
                    queue.mark(r)
                    at = at[~again]
            j = after[at]
            k = after[j]
            token[at] = r
            after[at] = k
            before[k] = at
            rank_at[j] = -1
            p = before[at]
            there = p >= 0
            if not there.all():
                p = p[there]
            new = self._join(np.concatenate((token[at], token[p])), np.concatenate((token[k], np.full(len(p), r))))
            place = np.concatenate((at, p))
            rank_at[place] = new
            ok = new >= 0
            if ok.any():
                new, place = new[ok], place[ok]
                order = np.lexsort((place, new))
                new, place = new[order], place[order]
                cuts = [0, *(np.flatnonzero(new[1:] != new[:-1]) + 1).tolist(), len(new)]
                for s, e in zip(cuts, cuts[1:]):
                    x = int(new[s])
                    bucket = buckets.get(x)
                    if bucket is None:
                        buckets[x] = [place[s:e]]
                        queue.mark(x)
                    else:
                        bucket.append(place[s:e])
        # Joined positions keep old links, so the tokens are found by walking from each start, all words at once.
        out_pos, cur = [], np.concatenate(([0], ends[:-1] + 1)) if len(words) else np.zeros(0, np.int64)
        cur = cur[token[cur] != stop]
        while len(cur):
            out_pos.append(cur)
            cur = after[cur]
            cur = cur[token[cur] != stop]
        if not out_pos:
            return [() for _ in words]
        pos = np.sort(np.concatenate(out_pos))
        count = np.bincount(word[pos], minlength=len(words))
        ids, out, s = token[pos].tolist(), [], 0
        for c in count.tolist():
            out.append(tuple(ids[s : s + c]))
            s += c
        return out

    def learn(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of the words that aren't known yet: long ones one by one, the others side by side."""
        short, out = [w for w in words if len(w) <= _LONGEST], {}
        for w in words:
            if len(w) > _LONGEST:
                out[w] = tuple(self.merge(w.encode("utf-8")))
        for s in range(0, len(short), _SIDE):
            part = short[s : s + _SIDE]
            out.update(zip(part, self.merge_many([w.encode("utf-8") for w in part])))
        return out

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        known = self.known
        split = [pre_tokens(t, self.pattern) for t in texts]
        fresh: set[str] = set()
        for words in split:
            fresh.update(words)
        fresh.difference_update(known)
        extra = self.learn(fresh)
        if len(known) + len(extra) <= REMEMBERED:
            known.update(extra)
            get = known.__getitem__
        else:  # no room: the new ones serve this batch only
            for w in itertools.islice(extra, max(0, REMEMBERED - len(known))):
                known[w] = extra[w]
            both = extra if len(extra) > len(known) else known
            other = known if both is extra else extra

            def get(w):
                ids = both.get(w)
                return other[w] if ids is None else ids

        return [list(chain.from_iterable(map(get, words))) for words in split]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """The encoder of a rank file; each Python worker reads it once."""
    with open(path, "rb") as lines:
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


def bpe_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>, decoded binary): ids of each whole text, and the bytes that those ids decode to.

    A null or empty text has no ids and decodes to nothing. A repeated row is encoded like any other. No character of a
    text is dropped: what the pattern matches covers it whole, and the round trip is exact. One very long pre-token is
    merged in time that grows with its length times the steps of a heap of equal ranks; shorter ones are merged many at
    a time, once for each batch and word.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = load(path)
        for batch in sliced(batches, 1, _SLICE):
            ids = bpe.encode_batch([t.decode("utf-8") for t in blobs(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(bpe.decode, ids), pa.binary())], names=[id_col, "ids", "decoded"])

    cols = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("binary").alias("__text"))
    return cols.transform(arrow_map, run, f"`{id_col}` {kind}, ids array<int>, decoded binary")


def bpe_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): what bpe_tokens gives, as a length and digests taken beside the encoder."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = load(path)
        spell = [str(i) for i in range(max(bpe.bytes_of) + 1)].__getitem__
        for batch in sliced(batches, 1, _SLICE):
            n, of_ids, of_bytes = [], [], []
            for ids in bpe.encode_batch([t.decode("utf-8") for t in blobs(batch.column(1))]):
                n.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(spell, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    cols = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("binary").alias("__text"))
    return cols.transform(arrow_map, run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op10_bitmap_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return bpe_digests(plain_names(table(spark, sf_dir, "documents"), ["doc_id", "text"]))
