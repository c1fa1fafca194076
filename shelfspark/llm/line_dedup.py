"""Line dedup by an exact set-similarity join: lines as word sets, words by rarity, prefix, length, positional and bitmap filters, verified Jaccard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IdFilter, arrow_map, blobs, checkpointed, maybe_in, plain_names, shuffle_width, sliced, table

#: Words are counted in so many hashed buckets: a table of fixed size that gives every word a place in the order by rarity.
BUCKETS = 1 << 18
_SLICES = 16
#: Postings of words that occur more often than this are dealt out in blocks.
_BLOCK_LINES = 1 << 16
#: In the first round the sets that share a word are compared with so many earliest ones of them.
_REACH = 2048
_PAIRS = 1 << 18
#: Sets above this size have a bitmap of 256 bits.
_SMALL_SET = 32
_LEVELS = 9
#: Candidates to verify of a line whose nearest is far within the bound.
_SURE = 8


def levels(counts: np.ndarray) -> np.ndarray:
    """Places in the order by rarity: the logarithm of counts, in steps of a sixteenth."""
    return np.minimum(16 * np.log2(counts + 1.0), (1 << _LEVELS) - 1).astype(np.uint16)


#: Words of more bytes are hashed one by one: sums of powers of two letters can cancel in the last bits, the more the longer the word.
_LONG = 32
#: For the counts of a slice.
_LOW_COUNTS = levels(np.arange(1 << 16))
_PIECE = 1 << 18
#: Bytes of text that a task works on at once; postings are dealt out when so many wait, more if there are very many parts.
_SLICE = 2 << 20
_WAIT = 1 << 18


def line_words(line: bytes) -> list[bytes]:
    """The distinct words of a line (A-Z lowered, split at ASCII white space), sorted."""
    return sorted(set(line.lower().split()))


class _Hasher:
    """Two 64-bit hashes of every word in a run of bytes at once: sums of a random value for each byte (A-Z as a-z) times powers of an odd number, taken from running sums; XXH3's 128 bits for words above _LONG."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.value = rng.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
        self.value[:, 65:91] = self.value[:, 97:123]
        self.odd = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
        self.white = np.zeros(256, dtype=bool)
        self.white[[9, 10, 11, 12, 13, 32]] = True
        self.size = 0
        self._grow(_PIECE)

    def _grow(self, n: int) -> None:
        power = lambda p: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, p, np.uint64))))
        self.up, self.down = [power(p) for p in self.odd], [power(pow(p, -1, 1 << 64)) for p in self.odd]
        self.size = n

    def pieces(self, data: bytes):
        """(start, stop) of pieces of at most _PIECE bytes, unless one word is longer."""
        at = 0
        while at < len(data):
            stop = min(len(data), at + _PIECE)
            if stop < len(data):
                a = np.frombuffer(data, dtype=np.uint8, count=stop - at, offset=at)
                gaps = np.flatnonzero(self.white[a[::-1][: 1 << 12]])
                gaps = gaps if len(gaps) else np.flatnonzero(self.white[a[::-1]])
                if len(gaps):
                    stop -= int(gaps[0])
                else:
                    ahead = np.frombuffer(data, dtype=np.uint8, offset=stop)
                    gaps = np.flatnonzero(self.white[ahead])
                    stop = stop + int(gaps[0]) if len(gaps) else len(data)
            yield at, stop
            at = stop

    def words(self, data: bytes, both: bool = True):
        """(first hash, second hash or None, number of line feeds before) of every word, in order."""
        out, feeds = [], 0
        for at, stop in self.pieces(data):
            a = np.frombuffer(data, dtype=np.uint8, count=stop - at, offset=at)
            if len(a) > self.size:
                self._grow(2 * len(a))
            ink = ~self.white[a]
            edge = np.flatnonzero(ink[1:] != ink[:-1]) + 1
            edge = np.concatenate((np.zeros(int(ink[0]), np.int64), edge, np.full(int(ink[-1]), len(a), np.int64)))
            start, end = edge[::2], edge[1::2]
            hashes = []
            for k in range(2 if both else 1):
                run = np.zeros(len(a) + 1, dtype=np.uint64)
                x = self.value[k][a]
                x *= self.up[k][: len(a)]
                np.cumsum(x, out=run[1:])
                hashes.append((run[end] - run[start]) * self.down[k][start])
            for w in np.flatnonzero(end - start > _LONG).tolist():
                strong = xxhash.xxh3_128_intdigest(data[at + int(start[w]) : at + int(end[w])].lower())
                for k, h in enumerate(hashes):
                    h[w] = strong >> 64 * k & 0xFFFFFFFFFFFFFFFF
            feed = np.cumsum(a == 10, dtype=np.int32)
            out.append((hashes[0], hashes[-1], feed[start].astype(np.int64) + feeds))
            feeds += int(feed[-1])
        if not out:
            z = np.zeros(0, dtype=np.uint64)
            return z, z, z.astype(np.int64)
        return tuple(np.concatenate(x) for x in zip(*out))


_HASHERS: list[_Hasher] = []


def _hasher() -> _Hasher:
    """One for each worker."""
    if not _HASHERS:
        _HASHERS.append(_Hasher())
    return _HASHERS[0]


def word_counts(docs: DataFrame, num: int = 4, den: int = 5, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Over all texts, of the words of each bucket: occurrences, and how often they would stand in a line's prefix if each slice of the input ordered words by its own counts.

    The second only says which words are dealt out in blocks. The sums of all tasks meet in slices, not in one task.
    """

    def count(batches):
        total, hasher = np.zeros(2 * BUCKETS, dtype=np.int64), _hasher()
        for batch in sliced(batches, 0):
            words, _, line = hasher.words(b"\n".join(blobs(batch.column(0))), both=False)
            own = np.bincount((words % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
            total[:BUCKETS] += own
            _, size, _, words = line_sets(words, None, line, _LOW_COUNTS[np.minimum(own, len(_LOW_COUNTS) - 1)])
            first = np.cumsum(size) - size
            long = np.where(can_pair(size, num, den), size - -(-size * num // den) + 1, 0)
            at = np.repeat(first - np.cumsum(long) + long, long) + np.arange(long.sum())
            total[BUCKETS:] += np.bincount((words[at] % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        yield _sliced(total)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zstandard.decompress(blob), dtype=np.int64)
                sums[k] = sums[k] + part if k in sums else part
        keys = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([zstandard.compress(sums[k].tobytes(), 1) for k in keys], pa.binary())], names=["slice", "counts"])

    parts = docs.select(F.col(f"`{text_col}`").cast("binary").alias("text")).transform(arrow_map, count, "slice int, counts binary")
    total = np.zeros(2 * BUCKETS, dtype=np.int64)
    width = len(total) // _SLICES
    for r in parts.repartition(_SLICES, "slice").transform(arrow_map, add, "slice int, counts binary").collect():
        total[r["slice"] * width : (r["slice"] + 1) * width] += np.frombuffer(zstandard.decompress(bytes(r["counts"])), dtype=np.int64)
    return total[:BUCKETS], total[BUCKETS:]


class _Order:
    """What a task must know of the counts: each bucket's level of rarity and number of blocks."""

    def __init__(self, counts: np.ndarray, prefixes: np.ndarray, parts: int):
        self.levels = levels(counts)
        # A word is dealt out in blocks where its postings would be a good part of a task's.
        self.blocks = 1 + prefixes // max(_BLOCK_LINES, int(prefixes.sum()) // parts)


def _sliced(total: np.ndarray) -> pa.RecordBatch:
    parts = total.reshape(_SLICES, -1)
    return pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array([zstandard.compress(p.tobytes(), 1) for p in parts], pa.binary())], names=["slice", "counts"])


#: flag: 1 for a line that searches in a later round, 2 for a word of which only some blocks meet.
_POSTING = {"token": "<u8", "id": "<u8", "bits": "<u8", "bits1": "<u8", "bits2": "<u8", "bits3": "<u8", "doc": "<i8", "line": "<i4", "size": "<i4", "place": "<i4", "block": "<u4", "flag": "u1"}
_PLACE = {"id": "<u8", "id1": "<u8", "doc": "<i8", "line": "<i4"}
_LANES = ("bits", "bits1", "bits2", "bits3")
Rows = dict[str, np.ndarray]


def _distance(rows: Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Differing bits of the bitmaps, never more than the words in which the sets differ."""
    apart = [rows[n][i] ^ rows[n][j] for n in _LANES]
    wide = sum(np.bitwise_count(x).astype(np.int64) for x in apart)
    narrow = np.bitwise_count(apart[0] ^ apart[1] ^ apart[2] ^ apart[3]).astype(np.int64)
    return np.where((rows["size"][i] > _SMALL_SET) & (rows["size"][j] > _SMALL_SET), wide, narrow)


def _at(rows: Rows, which) -> Rows:
    return {n: c[which] for n, c in rows.items()}


def _joined(parts: list[Rows], form: dict[str, str]) -> Rows:
    return {n: np.concatenate([p[n] for p in parts] or [np.empty(0, form[n])]) for n in form}


def _pack(rows: Rows) -> bytes:
    return zstandard.compress(b"".join(c.tobytes() for c in rows.values()), 1)


def _unpack(blob: bytes, form: dict[str, str]) -> Rows:
    data = zstandard.decompress(blob)
    n = len(data) // sum(np.dtype(k).itemsize for k in form.values())
    rows, at = {}, 0
    for name, kind in form.items():
        rows[name] = np.frombuffer(data, dtype=kind, count=n, offset=at)
        at += rows[name].nbytes
    return rows


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def line_sets(words: np.ndarray, second: np.ndarray | None, line: np.ndarray, level_of: np.ndarray):
    """(line, size, ids, words) of the lines with a word: their distinct words, each line's from rare to common, and (with second hashes) 128 bits that are equal for equal sets.

    The order by rarity is one for all lines: by the logarithm of the count, then by hash. Sorted are 64-bit keys of line,
    level and leading bits of the hash; where two words of a line share a key, all is sorted in full.
    """
    if not len(words):
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros((0, 2), np.uint64), words
    own = np.cumsum(np.diff(line, prepend=line[0]) != 0)
    mixed = _mix(words)
    bucket = (words % np.uint64(BUCKETS)).astype(np.int64)
    level = level_of[bucket].astype(np.uint64)
    bits = max(1, int(own[-1]).bit_length())
    low = 64 - bits - _LEVELS
    key = (own.astype(np.uint64) << np.uint64(64 - bits)) | (level << np.uint64(low)) | (mixed >> np.uint64(64 - low))
    order = np.argsort(key)
    key, by, o = key[order], words[order], own[order]
    if ((key[1:] == key[:-1]) & (by[1:] != by[:-1])).any():
        order = np.lexsort((mixed, level, own))
        by, o = words[order], own[order]
    new = np.concatenate(([True], (by[1:] != by[:-1]) | (o[1:] != o[:-1])))
    by, o = by[new], o[new]
    size = np.bincount(o)
    lines = line[np.flatnonzero(np.diff(line, prepend=line[0] - 1))]
    if second is None:
        return lines, size, None, by
    other = second[order[new]]
    first = np.cumsum(size) - size
    ids = np.empty((len(size), 2), dtype=np.uint64)
    ids[:, 0] = np.add.reduceat(_mix(by + np.uint64(0x632BE59BD9B4E019)), first)
    ids[:, 1] = np.add.reduceat(_mix(_mix(other) ^ np.uint64(0x8CB92BA72F3D8DD7)), first)
    return lines, size, ids, by


def can_pair(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether a set of so many words can reach num / den with another set."""
    return (size * den // num > size) | (-(-size * num // den) < size)


def prefix_postings(words: np.ndarray, size: np.ndarray, ids: np.ndarray, docs: np.ndarray, lines: np.ndarray, blocks: np.ndarray, num: int, den: int) -> Rows:
    """The postings of the prefixes of so many sets, words from rare to common: the rarest n - ceil(t n) + 1 words of a set of n, at t = num / den."""
    sets = len(size)
    if not sets:
        return _joined([], _POSTING)
    owner, first = np.repeat(np.arange(sets), size), np.cumsum(size) - size
    # A bitmap of 64 bits, or of 4 x 64 for large sets; the xor of the four is the one of 64 bits.
    mixed = _mix(words)
    bit = np.uint64(1) << (mixed >> np.uint64(58))
    lane = np.where((size > _SMALL_SET)[owner], (mixed >> np.uint64(56)) & np.uint64(3), np.uint64(0))
    bits = [np.bitwise_xor.reduceat(np.where(lane == k, bit, np.uint64(0)), first) for k in range(4)]
    long = size - -(-size * num // den) + 1
    own = np.repeat(np.arange(sets), long)
    place = np.arange(len(own)) - np.repeat(np.cumsum(long) - long, long)
    token = words[first[own] + place]
    rows = {"token": token, "id": ids[own], **{n: bits[k][own] for k, n in enumerate(_LANES)}, "doc": docs[own], "line": lines[own], "size": size[own], "place": place, "block": np.zeros(len(own)), "flag": np.zeros(len(own))}
    return _blocked({n: c.astype(_POSTING[n], copy=False) for n, c in rows.items()}, blocks)


def _blocked(rows: Rows, blocks: np.ndarray, searching: np.ndarray | None = None) -> Rows:
    """Rows of words of n blocks, in block 1 to n of their word: without searching, the first block's rows meet those of every block, the others their own; with it, the lines that search meet every block."""
    n = blocks[(rows["token"] % np.uint64(BUCKETS)).astype(np.int64)]
    if not (n > 1).any():
        return rows
    out = [_at(rows, n == 1)]
    for k in np.unique(n[n > 1]).tolist():
        hot = _at(rows, n == k)
        own = hot["id"] % np.uint64(k)
        wide = own == 0 if searching is None else searching[n == k]
        if searching is None:
            hot["flag"] = np.full(len(own), 2, np.uint8)
        for x in range(k):
            copy = _at(hot, wide | (own == np.uint64(x)))
            copy["block"] = np.full(len(copy["id"]), x + 1, np.uint32)
            out.append(copy)
    return _joined(out, _POSTING)


def _group_key(rows: Rows) -> np.ndarray:
    """The word, or for a word of several blocks the word and the block."""
    return np.where(rows["block"] == 0, rows["token"], _mix(rows["token"] + rows["block"].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def _spans(start: np.ndarray, stop: np.ndarray):
    """(i, j) with j from start[i] to stop[i], in pieces of about _PAIRS."""
    n = np.maximum(stop - start, 0)
    ends, at = np.cumsum(n), 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, "right")))
        k = n[at:to]
        i = np.repeat(np.arange(at, to), k)
        yield i, start[i] + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
        at = to


def best_candidates(rows: Rows, num: int, den: int, most: int, reach: int | None = _REACH) -> tuple[tuple[np.ndarray, ...], Rows]:
    """(later doc, later line, earlier doc, earlier line, more) of the pairs of sets that share a word and pass the filters; and the rows of the words of sets with more.

    Of each later set the `most` pairs nearest by bitmap come; more says that there were others, or that not all earlier
    sets were looked at: sets of a word are compared with its `reach` earliest, however many there are; without a
    reach only the flagged ones are, with all. Sets with more but without a pair come with an earlier line -1.
    """
    z = np.zeros(0, dtype=np.int64)
    nothing = (z, z, z, z, z.astype(bool)), _joined([], _POSTING)
    key = _group_key(rows)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    shared = np.concatenate(([False], same))[: len(key)]
    shared[:-1] |= same
    shared |= rows["flag"][order] == 2
    rows = _at(rows, order[shared])
    key = key[order[shared]]
    if not len(key):
        return nothing
    order = np.lexsort((rows["line"], rows["doc"], rows["id"], key))
    rows, key = _at(rows, order), key[order]
    new = np.ones(len(key), dtype=bool)  # a set is known by its first line
    new[1:] = key[1:] != key[:-1]
    for name in ("id", "size", *_LANES):
        new[1:] |= rows[name][1:] != rows[name][:-1]
    rows, key = _at(rows, new), key[new]
    order = np.lexsort((rows["size"], key))
    rows, key = _at(rows, order), key[order]
    group = np.cumsum(np.diff(key, prepend=key[0]) != 0)
    n = np.bincount(group)[group]
    if not (n > 1).any() and not (rows["flag"] == 2).any():
        return nothing
    size, place = rows["size"].astype(np.int64), rows["place"].astype(np.int64)
    key = (group << 32) + size
    low, high = (group << 32) + -(-size * num // den), (group << 32) + size * den // num
    open_ = rows["flag"] == 2
    pieces = []
    if reach:
        large = n > reach
        small = np.flatnonzero(~large & (n > 1))
        if len(small):
            pieces.append((small, small, np.arange(len(small)) + 1, np.searchsorted(key[small], high[small], "right")))
        if large.any():
            at = np.flatnonzero(large)
            order = at[np.lexsort((rows["line"][at], rows["doc"][at], group[at]))]
            begin = np.flatnonzero(np.diff(group[order], prepend=-1))
            rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
            open_[order[rank >= reach]] = True
            first = np.sort(order[rank < reach])
            pieces.append((at, first, np.searchsorted(key[first], low[at]), np.searchsorted(key[first], high[at], "right")))
    else:
        at = np.flatnonzero(rows["flag"] == 1)
        pieces.append((at, np.arange(len(key)), np.searchsorted(key, low[at]), np.searchsorted(key, high[at], "right")))
    sure = min(_SURE, most) if reach else most
    kept: list[np.ndarray] = []
    held, bound = 0, 2 * _PAIRS
    for left, right, start, stop in pieces:
        for i, j in _spans(start, stop):
            i, j = left[i], right[j]
            both = size[i] + size[j]
            need = -(-both * num // (num + den))
            ok = np.minimum(size[i] - place[i], size[j] - place[j]) >= need
            i, j, slack = i[ok], j[ok], (both - 2 * need)[ok]
            after = (rows["doc"][i] > rows["doc"][j]) | ((rows["doc"][i] == rows["doc"][j]) & (rows["line"][i] > rows["line"][j]))
            if left is right:  # each pair comes once, in either order
                i, j = np.where(after, i, j), np.where(after, j, i)
            else:
                i, j, slack = i[after], j[after], slack[after]
            far = _distance(rows, i, j)
            ok = far <= slack
            if ok.any():
                i, j = i[ok], j[ok]
                kept.append(np.stack([rows["doc"][i], rows["line"][i], far[ok], rows["doc"][j], rows["line"][j], open_[i], slack[ok]]).astype(np.int64))
                held += len(i)
                if held > bound:
                    kept = [_nearest(np.concatenate(kept, axis=1), most, sure)]
                    held = kept[0].shape[1]
                    bound = max(2 * _PAIRS, 2 * held)
    if open_.any():
        at = np.flatnonzero(open_)
        z = np.zeros(len(at), np.int64)
        kept.append(np.stack([rows["doc"][at], rows["line"][at], z + (1 << 40), z, z - 1, z + 1, z]).astype(np.int64))
    if not sum(k.shape[1] for k in kept):
        return nothing
    got = _nearest(np.concatenate(kept, axis=1), most, sure)
    more = got[5].astype(bool)
    lines = np.unique(line_key(got[0], got[1])[more])
    where = np.searchsorted(lines, mine := line_key(rows["doc"], rows["line"].astype(np.int64)))
    again = np.zeros(int(group[-1]) + 1, dtype=bool)
    again[group[(where < len(lines)) & (lines[np.minimum(where, len(lines) - 1)] == mine)] if len(lines) else z[:0]] = True
    again |= np.bincount(group, rows["block"], len(again)) > 0  # other blocks may have them
    return (got[0], got[1], got[3], got[4], more), _at(rows, again[group])


def _nearest(pairs: np.ndarray, most: int, sure: int) -> np.ndarray:
    """Of each later line the `most` nearest pairs, or `sure` where the nearest is far within the bound; rows without a pair only where there is none."""
    pairs = pairs[:, np.lexsort((pairs[4], pairs[3], pairs[2], pairs[1], pairs[0]))]
    same = (pairs[[0, 1, 3, 4], 1:] == pairs[[0, 1, 3, 4], :-1]).all(axis=0)
    pairs = _merged(pairs, same) if same.any() else pairs
    new = np.concatenate(([True], (pairs[0, 1:] != pairs[0, :-1]) | (pairs[1, 1:] != pairs[1, :-1])))
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate((first, [pairs.shape[1]])))
    real = np.add.reduceat((pairs[4] >= 0).astype(np.int64), first)
    place = np.arange(pairs.shape[1]) - np.repeat(first, n)
    take = np.where(pairs[2, first] * 5 // 4 + 2 <= pairs[6, first], sure, most)
    pairs[5] = np.repeat(np.maximum.reduceat(pairs[5], first) | (real > take), n)
    return pairs[:, place < np.repeat(np.maximum(1, np.minimum(take, real)), n)]


def _merged(pairs: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Equal pairs once, open if one of them is."""
    first = np.flatnonzero(np.concatenate(([True], ~same)))
    out = pairs[:, first]
    out[5] = np.maximum.reduceat(pairs[5], first)
    return out


def line_key(doc, line):
    """A bigint for the Bloom filter of lines."""
    return doc ^ (line << 40)


def _postings(docs: DataFrame, order, parts: int, num: int, den: int) -> DataFrame:
    """(part, rows): for parts below `parts` packed postings; for the next so many the first line of each set in a slice of the input; for the last the other lines of those sets, which are removed whatever the rest holds."""

    def run(batches):
        hasher, known = _hasher(), order.value
        posted, first, gone = [], [], []
        most, waiting = min(max(_WAIT, 64 * parts), 4 * _WAIT), 0

        def dealt():
            rows, places, copies = _joined(posted, _POSTING), _joined(first, _PLACE), _joined(gone, _PLACE)
            posted.clear(), first.clear(), gone.clear()
            got = _dealt(rows, _mix(_group_key(rows)), parts, 0) + _dealt(places, places["id1"], parts, parts)
            if len(copies["id"]):
                got.append((2 * parts + int(copies["id"][0] % np.uint64(parts)), _pack(copies)))
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.int32()), pa.array([b for _, b in got], pa.binary())], names=["part", "rows"])

        for batch in sliced(batches, 1, _SLICE):
            there = [(doc, text) for doc, text in zip(batch.column(0).to_pylist(), blobs(batch.column(1))) if doc is not None]
            own = np.array([d for d, _ in there], dtype=np.int64)
            # Texts stand one after the other; line feeds before a text give its first line's number.
            before = np.concatenate(([0], np.cumsum([t.count(b"\n") + 1 for _, t in there], dtype=np.int64)))
            lines, size, ids, words = line_sets(*hasher.words(b"\n".join([t for _, t in there])), known.levels)
            if not len(size):
                continue
            at = np.searchsorted(before, lines, "right") - 1
            place = {"id": ids[:, 0], "id1": ids[:, 1], "doc": own[at], "line": (lines - before[at]).astype(np.int32)}
            order_ = np.lexsort((place["line"], place["doc"], place["id1"], place["id"]))
            sorted_ = _at(place, order_)
            same = {n: sorted_[n][1:] == sorted_[n][:-1] for n in place}
            copy = np.concatenate(([False], same["id"] & same["id1"]))
            again = copy & np.concatenate(([False], same["doc"] & same["line"]))  # a repeated row
            firsts = np.zeros(len(size), dtype=bool)
            firsts[order_[~copy]] = True
            post = firsts & can_pair(size, num, den)
            posted.append(prefix_postings(words[np.repeat(post, size)], size[post], place["id"][post], place["doc"][post], place["line"][post], known.blocks, num, den))
            first.append(_at(place, firsts))
            gone.append(_at(sorted_, copy & ~again))
            waiting += len(posted[-1]["id"])
            if waiting > most:
                yield dealt()
                waiting = 0
        if first:
            yield dealt()

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).transform(arrow_map, run, "part int, rows binary")


def _postings_again(held: DataFrame, order, parts: int, searching: IdFilter) -> DataFrame:
    """(part, rows) of postings that were kept, for the lines that search: their words' postings, and those of all words in blocks."""

    def run(batches):
        for batch in batches:
            for blob in blobs(batch.column(0)):
                rows = _unpack(blob, _POSTING)
                hot = rows["block"] > 0  # only in the own block; it is dealt out anew
                own = rows["id"] % np.maximum(order.value.blocks[(rows["token"] % np.uint64(BUCKETS)).astype(np.int64)], 1).astype(np.uint64)
                rows = _at(rows, ~hot | (own + np.uint64(1) == rows["block"]))
                search = searching.holds(line_key(rows["doc"], rows["line"].astype(np.int64)))
                rows["flag"], rows["block"] = search.astype(np.uint8), np.zeros(len(search), np.uint32)
                rows = _blocked(rows, order.value.blocks, search)
                key = _group_key(rows)
                sort = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.concatenate(([True], key[sort][1:] != key[sort][:-1])))[: len(key)]
                wanted = np.logical_or.reduceat((rows["flag"][sort] == 1) | (rows["block"][sort] > 0), first) if len(key) else np.zeros(0, bool)
                rows = _at(rows, sort[np.repeat(wanted, np.diff(np.append(first, len(key))))])
                if len(rows["id"]):
                    got = _dealt(rows, _mix(_group_key(rows)), parts, 0)
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.int32()), pa.array([b for _, b in got], pa.binary())], names=["part", "rows"])

    return held.transform(arrow_map, run, "part int, rows binary")


def _dealt(rows: Rows, key: np.ndarray, parts: int, first: int) -> list[tuple[int, bytes]]:
    part = (key % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    rows = _at(rows, order)
    return [(first + p, _pack(_at(rows, slice(s, e)))) for p, (s, e) in enumerate(zip(cuts, cuts[1:])) if s < e]


def later_places(rows: Rows) -> Rows:
    """The rows whose set has an earlier line."""
    rows = _at(rows, np.lexsort((rows["line"], rows["doc"], rows["id1"], rows["id"])))
    same = {n: rows[n][1:] == rows[n][:-1] for n in rows}
    copy = np.concatenate(([False], same["id"] & same["id1"]))[: len(rows["id"])]
    again = np.concatenate(([False], same["doc"] & same["line"]))[: len(copy)]  # repeated rows count once
    return _at(rows, copy & ~again)


#: Parts that a task works on, one after the other.
_PARTS = 2
#: Kept postings travel in pieces of so many rows.
_CHUNK = 1 << 16


def _candidates(postings: DataFrame, parts: int, num: int, den: int, most: int, reach: int | None) -> DataFrame:
    """Pairs to verify, part by part, so that a task holds the postings of one part besides packed ones; lines that are removed as copies come with a null early_doc, lines without a pair that are still open with early_line -1, and the postings of the words of open lines with null lines."""

    def run(batches):
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), blobs(batch.column(1))):
                held.setdefault(p, []).append(blob)
        for p in list(held):
            form = _POSTING if p < parts else _PLACE
            rows = _joined([_unpack(blob, form) for blob in held.pop(p)], form)
            if p < parts:
                (doc, line, early, early_line, more), again = best_candidates(rows, num, den, most, reach)
            else:
                rows, again = later_places(rows) if p < 2 * parts else rows, {"id": ()}
                nothing = pa.nulls(len(rows["id"]), pa.int64())
                doc, line, early, early_line, more = rows["doc"], rows["line"], nothing, nothing.cast(pa.int32()), np.zeros(len(rows["id"]), dtype=bool)
            columns = [pa.array(doc), pa.array(line.astype(np.int32)), pa.array(early), pa.array(early_line).cast(pa.int32()), pa.array(more), pa.nulls(len(doc), pa.binary())]
            names = ["doc", "line", "early_doc", "early_line", "more", "rows"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            if reach:
                kept = pa.array([_pack(_at(again, slice(s, s + _CHUNK))) for s in range(0, len(again["id"]), _CHUNK)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[pa.nulls(len(kept), c.type) for c in columns[:5]], kept], names=names)

    return postings.repartition(max(1, parts // _PARTS), "part").transform(arrow_map, run, "doc bigint, line int, early_doc bigint, early_line int, more boolean, rows binary")


def _words_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, line, words) of the wanted lines (doc, line); words are joined by spaces."""
    by_doc = checkpointed(wanted.where("doc IS NOT NULL").groupBy(F.col("doc").alias("doc_id")).agg(F.sort_array(F.collect_set("line")).alias("lines")))
    texts = maybe_in(docs, IdFilter.of(by_doc, "doc_id"), "doc_id")
    rows = texts.join(by_doc, "doc_id").select("doc_id", F.col("text").cast("binary").alias("text"), "lines")

    def run(batches):
        for batch in sliced(batches, 1):
            out = []
            for doc, text, lines in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), batch.column(2).to_pylist()):
                split = text.split(b"\n")
                out += [(doc, k, b" ".join(line_words(split[k]))) for k in lines if k < len(split)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["doc", "line", "words"])

    return rows.transform(arrow_map, run, "doc bigint, line int, words binary")


def _verified(docs: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """(doc, line, more, alike): alike says that the Jaccard of the pair's word sets is num / den or more."""
    both = pairs.select("doc", "line").union(pairs.select(F.col("early_doc").alias("doc"), F.col("early_line").alias("line")))
    words = _words_of(docs, both)
    late = pairs.join(words.withColumnRenamed("words", "w"), ["doc", "line"])
    early = words.select(F.col("doc").alias("early_doc"), F.col("line").alias("early_line"), F.col("words").alias("v"))
    rows = late.join(early, ["early_doc", "early_line"]).select("doc", "line", "more", "w", "v")

    def run(batches):
        for batch in sliced(batches, 3):
            alike = []
            for w, v in zip(blobs(batch.column(3)), blobs(batch.column(4))):
                x, y = set(w.split()), set(v.split())
                common = len(x & y)
                alike.append(common * den >= (len(x) + len(y) - common) * num)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(alike, pa.bool_())], names=["doc", "line", "more", "alike"])

    return rows.transform(arrow_map, run, "doc bigint, line int, more boolean, alike boolean")


def removed_lines(docs: DataFrame, num: int = 4, den: int = 5, most: int = 32, reach: int = _REACH) -> DataFrame:
    """(doc_id, line) of every line with an earlier line (smaller doc_id, or the same and a smaller number) whose word set has Jaccard num / den or more with its own.

    Lines without a word are never removed. Lines of equal sets, which have Jaccard 1, are found by their set's id of 128
    bits from two hashes of each word. Between different sets each later one brings its `most` nearest candidates of each
    task (8, if the nearest is far within the bound) among the `reach` earliest sets of a word. Lines for which none of
    those holds though there were more stay open and search again, now all sets that share a word of their prefix and
    with eight times as many candidates, until none is open: so no candidate is lost, and near copies of one line cost
    `reach` comparisons each, not as many as there are of them. For that the first round keeps the postings of the
    words of open lines.
    """
    parts = _PARTS * shuffle_width(docs.sparkSession)
    order = docs.sparkSession.sparkContext.broadcast(_Order(*word_counts(docs, num, den), parts))
    pairs = checkpointed(_candidates(_postings(docs, order, parts, num, den), parts, num, den, most, reach))
    held = pairs.where("rows IS NOT NULL").select("rows")
    found = pairs.where("doc IS NOT NULL AND early_doc IS NULL").select("doc", "line")
    while True:
        pairs = pairs.where("early_doc IS NOT NULL").groupBy("doc", "line", "early_doc", "early_line").agg(F.max("more").alias("more"))
        seen = _verified(docs, checkpointed(pairs.where("early_line >= 0")), num, den).union(pairs.where("early_line < 0").select("doc", "line", "more", F.lit(False)))
        state = checkpointed(seen.groupBy("doc", "line").agg(F.max("alike").alias("alike"), F.max("more").alias("more")))
        found = found.union(state.where("alike").select("doc", "line"))
        open_ = state.where("more AND NOT alike").select(F.col("doc").bitwiseXOR(F.shiftleft(F.col("line").cast("bigint"), 40)).alias("key"))
        if open_.isEmpty():
            break
        most *= 8
        again = _postings_again(held, order, parts, IdFilter.of(open_, "key"))
        pairs = checkpointed(_candidates(again, parts, num, den, most, None))
    return found.distinct().withColumnRenamed("doc", "doc_id")


def line_dedup(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """docs with each text cut to the lines that removed_lines leaves, judged on the input, and n_lines, n_removed.

    A null text is one empty line and comes back empty; a document can lose all its lines (text ""). Rows with a null
    doc_id can't be placed before or after others and come back whole. Rows that repeat a doc_id must repeat the text;
    their lines count once. Other columns come back as they are; n_lines and n_removed replace columns of that name.
    No rows give no rows.
    """
    gone = checkpointed(removed_lines(plain_names(docs, ["doc_id", "text"]), num, den).groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("gone")))
    docs = docs.drop("n_lines", "n_removed")
    hit = IdFilter.of(gone, "doc_id")
    # Only texts that may have lost lines are shuffled.
    apart = gone.withColumnRenamed("doc_id", "__id").withColumnRenamed("gone", "__gone")
    touched = maybe_in(docs, hit, "doc_id").join(apart, F.col("doc_id") == F.col("__id"), "left").drop("__id")
    place, names = docs.columns.index("text"), [*docs.columns, "n_lines", "n_removed"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def cut(batches):
        for batch in sliced(batches, place):
            kept, n, dropped = [], [], []
            for text, gone in zip(blobs(batch.column(place)), batch.column(batch.num_columns - 1).to_pylist()):
                lines, gone = text.split(b"\n"), set(gone or ())
                n.append(len(lines))
                dropped.append(len(gone))
                kept.append(b"\n".join([x for k, x in enumerate(lines) if k not in gone]) if gone else text)
            cols = [*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(dropped, pa.int64())]
            cols[place] = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    touched = touched.withColumn("text", F.col("text").cast("binary")).select(*[F.col(f"`{c}`") for c in docs.columns], "__gone")
    touched = touched.transform(arrow_map, cut, f"{kinds}, n_lines bigint, n_removed bigint")
    rest = maybe_in(docs, hit, "doc_id", False).withColumn("text", F.coalesce("text", F.lit("")))
    lines = (F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    return touched.union(rest.select(*[F.col(f"`{c}`") for c in docs.columns], lines.alias("n_lines"), F.lit(0).cast("bigint").alias("n_removed")))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Line dedup of all documents at Jaccard 0.8 of the word sets of lines."""
    kept = line_dedup(plain_names(table(spark, sf_dir, "documents"), ["doc_id", "text"]))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
