"""Repeated passages by a sparse suffix array: anchored suffixes are range-partitioned by their leading bytes, sorted in their bucket by multikey quicksort, and compared across bucket boundaries.

Every window of `length` bytes has one anchor: the start of its K-gram of least hash, the leftmost on ties. Equal windows
have equal anchors at equal places, so a window can only repeat one whose anchor has the same K-gram; windows whose
K-gram is unique in the corpus are never shuffled. The rest is exact: windows are compared byte by byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IdFilter, arrow_map, blobs, checkpointed, maybe_in, plain_names, shuffle_width, sliced, table

#: Bytes of the K-gram at an anchor: the leading bytes by which suffixes are dealt out.
K = 24
_PIECE = 1 << 20
_NOBODY = np.iinfo(np.int64).min
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(a: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k bytes in a row, built from those of half the length."""
    h, n = (a.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1
    done, at = None, 0
    power = {1: _BASE}
    while n <= k:
        if k & n:
            if done is None:
                done, at = h, n
            else:
                m = len(a) - at - n + 1
                done, at = done[:m] * power[n] + h[at : at + m], at + n
        if 2 * n > k:
            break
        power[2 * n] = power[n] * power[n]
        m = len(h) - n
        h = h[:m] * power[n] + h[n : n + m]
        n *= 2
    x = done[: len(a) - k + 1]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _window_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w values in a row."""
    n = 1
    while 2 * n <= w:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (w - n)], x[w - n :]) if w > n else x


def anchors(data: bytes, length: int, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the K-gram, place of the anchor, first window, windows) of each anchor; windows of an anchor follow each other."""
    out: list[tuple[np.ndarray, ...]] = []
    w = length - k + 1
    windows = len(data) - length + 1
    with np.errstate(over="ignore"):
        for s in range(0, max(0, windows), _PIECE):
            a = np.frombuffer(data, dtype=np.uint8, count=min(len(data) - s, _PIECE + length - 1), offset=s)
            h = _gram_hashes(a, k)
            key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
            at = (_window_least(key, w) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            n = np.diff(np.concatenate((first, [len(at)])))
            out.append((h[at[first]], at[first] + s, first + s, n))
    if not out:
        z = np.zeros(0, dtype=np.int64)
        return z.astype(np.uint64), z, z, z
    return tuple(np.concatenate(x) for x in zip(*out))


def repeated_grams(docs: DataFrame, length: int, k: int, parts: int) -> DataFrame:
    """(owner, spots): for each text the places of its anchors whose K-gram comes more than once.

    Grams travel packed, a blob for each slice of the input and part. A gram that comes again within its slice is settled
    there and sent on once, without a place, so a gram in a third of all rows adds one entry for each slice.
    """

    def send(batches):
        for batch in sliced(batches, 1):
            grams, owners, spots = [], [], []
            for owner, text in zip(batch.column(0).to_pylist(), blobs(batch.column(1))):
                h, at, _, _ = anchors(text, length, k)
                grams.append(h)
                spots.append(at)
                owners.append(np.full(len(h), owner, dtype=np.int64))
            h, own, at = np.concatenate(grams or [np.zeros(0, np.uint64)]), np.concatenate(owners or [np.zeros(0, np.int64)]), np.concatenate(spots or [np.zeros(0, np.int64)])
            part = (h >> np.uint64(20)) % np.uint64(parts)
            order = np.lexsort((h, part))
            h, own, at, part = h[order], own[order], at[order], part[order]
            same = h[1:] == h[:-1]
            lead, again = np.concatenate(([True], ~same))[: len(h)], np.concatenate(([False], same))[: len(h)]
            again[:-1] |= same
            settled = (h[again], own[again], at[again])
            h, own, at, part = h[lead], np.where(again, _NOBODY, own)[lead], at[lead], part[lead]
            cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
            got = [(p, _squeeze(h[s:e], own[s:e], at[s:e])) for p, (s, e) in enumerate(zip(cuts, cuts[1:])) if s < e]
            if len(settled[0]):
                got.append((parts + int(settled[0][0] % np.uint64(parts)), _squeeze(*settled)))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.int32()), pa.array([b for _, b in got], pa.binary())], names=["part", "grams"])

    def answer(batches):
        held, done = [], []
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                (held if p < parts else done).append(_unsqueeze(blob.as_buffer().to_pybytes()))
        if not held and not done:
            return
        z = np.zeros(0, np.int64)
        h, own, at = (np.concatenate(x) for x in zip(*held)) if held else (z, z, z)
        del held
        order = np.argsort(h, kind="stable")
        h, own, at = h[order], own[order], at[order]
        same = h[1:] == h[:-1]
        again = np.concatenate(([False], same))[: len(h)]
        again[:-1] |= same
        again &= own != _NOBODY
        own, at = np.concatenate((own[again], *(x[1] for x in done))), np.concatenate((at[again], *(x[2] for x in done)))
        part = ((own.view(np.uint64) * _BASE) >> np.uint64(32)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        own, at, part = own[order], at[order], part[order]
        cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        got = [(p, zstandard.compress(own[s:e].tobytes() + at[s:e].tobytes(), 1)) for p, (s, e) in enumerate(zip(cuts, cuts[1:])) if s < e]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.int32()), pa.array([b for _, b in got], pa.binary())], names=["part", "spots"])

    def gather(batches):
        held = []
        for batch in batches:
            for blob in batch.column(1):
                data = zstandard.decompress(blob.as_buffer().to_pybytes())
                held.append(np.frombuffer(data, np.int64).reshape(2, -1))
        if not held:
            return
        own, at = np.concatenate(held, axis=1)
        del held
        order = np.lexsort((at, own))
        own, at = own[order], at[order]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        for s in range(0, len(first), 4096):
            f = first[s : s + 4096]
            stop = first[s + 4096] if s + 4096 < len(first) else len(own)
            offsets = np.concatenate((f, [stop])) - f[0]
            yield pa.RecordBatch.from_arrays([pa.array(own[f]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(at[f[0] : stop]))], names=["owner", "spots"])

    sent = docs.select("owner", "data").transform(arrow_map, send, "part int, grams binary").repartition(parts, "part")
    answers = sent.transform(arrow_map, answer, "part int, spots binary").repartition(parts, "part")
    return answers.transform(arrow_map, gather, "owner bigint, spots array<bigint>")


def _squeeze(h: np.ndarray, own: np.ndarray, at: np.ndarray) -> bytes:
    return zstandard.compress(h.tobytes() + own.tobytes() + at.astype("<i4").tobytes(), 1)


def _unsqueeze(blob: bytes):
    data = zstandard.decompress(blob)
    n = len(data) // 20
    return np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.int64, n, 8 * n), np.frombuffer(data, "<i4", n, 16 * n).astype(np.int64)


def equal_windows(group: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A class number for each row: rows are in one class if their group and all their words are equal.

    Multikey quicksort, a level at a time for all segments at once: rows equal to their segment's first in a word go on
    to the next word unsorted; only segments with an unequal row are sorted by that word and split.
    """
    n, depth = words.shape
    order = np.argsort(group, kind="stable")
    cls = np.cumsum(np.concatenate(([0], (group[order][1:] != group[order][:-1]).astype(np.int64)))) if n else np.zeros(0, np.int64)
    live = order  # rows that still share their segment with another, segment by segment
    seg = cls
    label = np.empty(n, dtype=np.int64)
    label[order] = cls
    fresh = int(cls[-1]) + 1 if n else 0
    for d in range(depth):
        counts = np.bincount(seg) if len(seg) else np.zeros(0, int)
        keep = counts[seg] > 1
        live, seg = live[keep], seg[keep]
        if not len(live):
            break
        starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(seg)])))
        w = words[live, d]
        differs = w != np.repeat(w[starts], sizes)
        split = np.repeat(np.logical_or.reduceat(differs, starts), sizes)
        if split.any():
            rows, s, x = live[split], seg[split], w[split]
            by = np.lexsort((x, s))
            rows, s, x = rows[by], s[by], x[by]
            new = np.cumsum(np.concatenate(([0], ((s[1:] != s[:-1]) | (x[1:] != x[:-1])).astype(np.int64)))) + fresh
            fresh = int(new[-1]) + 1
            label[rows] = new
            live[split], seg[split] = rows, new
        _, seg = np.unique(seg, return_inverse=True)
        by = np.argsort(seg, kind="stable")
        live, seg = live[by], seg[by]
    return label


def _contexts(data: bytes, at: np.ndarray, length: int, k: int) -> np.ndarray:
    """Of each anchor the bytes that windows around it can hold, with zeros beyond the text's ends."""
    left, right = length - k, length
    a = np.frombuffer(b"\0" * left + data + b"\0" * right, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(a, left + right)[at]


def repeated_windows(rows: DataFrame, length: int, k: int, parts: int) -> DataFrame:
    """(owner, start, stop): bytes of windows that also start earlier, as runs, from rows (gram, owner, at, first, n, around).

    Rows are range-partitioned by sampled splitters of (gram, owner, at) and sorted. A gram that only one bucket holds is
    settled there. For one that runs over a boundary every bucket sends, of each class of equal windows, the earliest
    with a digest; those meet by digest, and classes with an earlier window elsewhere send their members' runs.
    """
    span = length - k
    ranged = rows.repartitionByRange(parts, "gram", "owner", "at").sortWithinPartitions("gram", "owner", "at")

    def bucket(batches):
        table_ = pa.Table.from_batches([b for b in batches if b.num_rows])
        if not table_.num_rows:
            return
        table_ = table_.combine_chunks()
        gram, owner, at, first, n = (table_.column(c).to_numpy() for c in ("gram", "owner", "at", "first", "n"))
        body = table_.column("around").combine_chunks()
        body = body.chunk(0) if isinstance(body, pa.ChunkedArray) else body
        around = np.frombuffer(body.buffers()[2], dtype=np.uint8, count=len(gram) * (span + length), offset=body.offset * (span + length)).reshape(-1, span + length)
        edge = (gram == gram[0]) | (gram == gram[-1])
        cuts = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        ends = np.concatenate((cuts[1:], [len(gram)]))
        # Grams are taken together up to so many windows.
        run, s = [], 0
        total = np.cumsum(n)
        for e, nxt in zip(ends.tolist(), [*ends[1:].tolist(), None]):
            if nxt is None or total[nxt - 1] - (total[s - 1] if s else 0) > 1 << 18:
                run.append((s, e))
                s = e
        for s, e in run:
            # Windows that hold the gram at different places are never equal, so a gram of very many windows is taken by places.
            step = -(-(span + 1) // max(1, int(n[s:e].sum()) >> 18))
            for low in range(0, span + 1, step):
                begin = np.maximum(first[s:e], at[s:e] - low - step + 1)
                held = np.maximum(0, np.minimum(first[s:e] + n[s:e] - 1, at[s:e] - low) - begin + 1)
                rows_ = np.flatnonzero(held) + s
                if len(rows_):
                    yield from settle(gram[rows_], owner[rows_], at[rows_], begin[rows_ - s], held[rows_ - s], around[rows_], edge[rows_])

    def settle(gram, owner, at, first, n, around, edge):
        row = np.repeat(np.arange(len(gram)), n)
        start = np.repeat(first, n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        back = np.repeat(at, n) - start  # the anchor's place in its window
        pad = -length % 8
        base = row * around.shape[1] + span - back
        flat = np.concatenate((around.ravel(), np.zeros(pad + 8, np.uint8)))
        # The words of a window by unaligned reads at every byte.
        view = np.lib.stride_tricks.as_strided(flat, shape=(len(flat) - 7, 8), strides=(1, 1))
        steps = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
        words = np.empty((len(row), len(steps)), dtype=np.uint64)
        for d, step in enumerate(steps):
            words[:, d] = np.ascontiguousarray(view[base + step]).view(np.uint64).ravel()
        _, g = np.unique(gram, return_inverse=True)
        cls = equal_windows(g[row] * (span + 1) + back, words)
        del words
        own = owner[row]
        order = np.lexsort((start, own, cls))
        lead = np.concatenate(([True], cls[order][1:] != cls[order][:-1]))
        later = np.zeros(len(row), dtype=bool)
        later[order[~lead]] = True
        yield runs(own[later], start[later], length, None)
        open_ = order[lead]
        open_ = open_[edge[row[open_]]]
        if len(open_):
            digest = [xxhash.xxh3_128_digest(flat[b : b + length].tobytes()) for b in base[open_].tolist()]
            yield runs(own[open_], start[open_], length, digest)

    def runs(own, start, length, digest):
        if digest is None:
            order = np.lexsort((start, own))
            own, start = own[order], start[order]
            if len(own):
                new = np.concatenate(([True], (own[1:] != own[:-1]) | (start[1:] > start[:-1] + length)))
                at = np.flatnonzero(new)
                last = np.concatenate((at[1:], [len(own)])) - 1
                own, start, stop = own[at], start[at], start[last] + length
            else:
                stop = start
            digest = pa.nulls(len(own), pa.binary())
        else:
            stop, digest = start + length, pa.array(digest, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(start, pa.int64()), pa.array(stop, pa.int64()), digest], names=["owner", "start", "stop", "digest"])

    kind = "owner bigint, start bigint, stop bigint, digest binary"
    settled = checkpointed(ranged.select("gram", "owner", "at", "first", "n", "around").transform(arrow_map, bucket, kind))
    open_ = settled.where("digest IS NOT NULL")
    least = open_.groupBy("digest").agg(F.min(F.struct("owner", "start")).alias("least"), F.count("*").alias("of")).where("of > 1")
    late = open_.join(least, "digest").where(F.struct("owner", "start") > F.col("least")).select("owner", "start", "stop")
    return settled.where("digest IS NULL").select("owner", "start", "stop").union(late)


def merged_spans(runs: DataFrame) -> DataFrame:
    """(owner, spans): the runs of each text joined where they meet or overlap, in order, as [start, stop]."""
    lists = runs.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("r"))

    def join(batches):
        for batch in batches:
            out = []
            for r in batch.column(1).to_pylist():
                spans: list[list[int]] = []
                for x in r:
                    if spans and x["start"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], x["stop"])
                    else:
                        spans.append([x["start"], x["stop"]])
                out.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.list_(pa.int64())))], names=["owner", "spans"])

    return lists.transform(arrow_map, join, "owner bigint, spans array<array<bigint>>")


def suffix_dedup(docs: DataFrame, length: int = 100, k: int = K, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """docs' (id, n_bytes, n_removed, spans, kept, text) and the columns named in keep: every byte of a text that a string of `length` bytes covers which also starts earlier is removed.

    Earlier: in a row of smaller id, or in the same row further left; strings are judged on the input. Equal texts are
    one class: only the row of least id is searched, the others lose all their bytes if they have `length` or more. A
    null text is empty. Rows that repeat an id must repeat the text and come back alike. A row with a null id can't be
    placed, so it comes back whole and removes nothing. No rows give no rows. kept holds the remaining
    bytes; text is the same without the pieces of characters that a removed run cuts through.
    """
    parts = shuffle_width(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("data"))
    more = [f"__k{i}" for i in range(len(keep))]
    every = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("data"), *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, more)])
    # Copies: texts by digest; a copy's id is not searched.
    digests = base.where("id IS NOT NULL").select("id", F.unhex(F.sha2("data", 256)).alias("digest"), F.length("data").alias("n"))
    firsts = digests.groupBy("digest").agg(F.min("id").alias("owner"), F.count("*").alias("of")).where("of > 1").select("digest", "owner")
    copies = checkpointed(digests.join(firsts, "digest").where("id > owner").select("id", "n").distinct())
    copy_ids = copies.select("id")
    filter_ = IdFilter.of(copy_ids, "id")
    sound = base.where("id IS NOT NULL")
    single = maybe_in(sound, filter_, "id", False).union(maybe_in(sound, filter_, "id").join(copy_ids, "id", "left_anti").dropDuplicates(["id"])).withColumnRenamed("id", "owner")
    spots = checkpointed(repeated_grams(single, length, k, parts))
    texts = maybe_in(single, IdFilter.of(spots, "owner"), "owner").join(spots, "owner").select("owner", "data", "spots")

    def around(batches):
        for batch in sliced(batches, 1):
            held: list[tuple] = []
            for owner, text, want in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), batch.column(2)):
                h, at, first, n = anchors(text, length, k)
                take = np.flatnonzero(np.isin(at, want.values.to_numpy()))
                for s in range(0, len(take), 1 << 14):
                    t = take[s : s + (1 << 14)]
                    held.append((h[t].view(np.int64), np.full(len(t), owner, np.int64), at[t], first[t], n[t], _contexts(text, at[t], length, k)))
                    if sum(len(x[0]) for x in held) > 1 << 14:
                        yield packed(held)
                        held = []
            if held:
                yield packed(held)

    def packed(held):
        *cols, wide = (np.concatenate(x) for x in zip(*held))
        offsets = np.arange(len(wide) + 1, dtype=np.int32) * wide.shape[1]
        body = pa.Array.from_buffers(pa.binary(), len(wide), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(wide).tobytes())])
        return pa.RecordBatch.from_arrays([*[pa.array(c) for c in cols], body], names=["gram", "owner", "at", "first", "n", "around"])

    rows = texts.transform(arrow_map, around, "gram bigint, owner bigint, at bigint, first bigint, n bigint, around binary")
    whole = copies.where(F.col("n") >= length).select(F.col("id").alias("owner"), F.lit(0).cast("bigint").alias("start"), F.col("n").cast("bigint").alias("stop"))
    spans = checkpointed(merged_spans(repeated_windows(rows, length, k, parts).union(whole)))

    def cut(batches):
        for batch in sliced(batches, 1):
            size, gone, kept, whole = [], [], [], []
            for text, s in zip(blobs(batch.column(1)), batch.column(2).to_pylist()):
                s, at, out = s or [], 0, []
                for a, b in s:
                    out.append(text[at:a])
                    at = b
                out.append(text[at:])
                size.append(len(text))
                gone.append(sum(b - a for a, b in s))
                kept.append(b"".join(out))
                whole.append(kept[-1].decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), batch.column(2), pa.array(kept, pa.binary()), pa.array(whole, pa.string()), *batch.columns[3:]], names=["id", "n_bytes", "n_removed", "spans", "kept", "text", *more])

    hit = IdFilter.of(spans, "owner")
    kinds = "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(keep, more))
    touched = maybe_in(every, hit, "id").join(spans.withColumnRenamed("owner", "id"), "id", "left").select("id", "data", "spans", *more)
    touched = touched.transform(arrow_map, cut, "id bigint, n_bytes bigint, n_removed bigint, spans array<array<bigint>>, kept binary, text string" + kinds)
    none = F.array().cast("array<array<bigint>>")
    rest = maybe_in(every, hit, "id", False).select("id", F.length("data").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"), none.alias("spans"), F.col("data").alias("kept"), F.col("data").cast("string").alias("text"), *more)
    out = touched.withColumn("spans", F.coalesce("spans", none)).union(rest)
    return out.select(F.col("id").cast(kind).alias(id_col), "n_bytes", "n_removed", "spans", "kept", "text", *[F.col(n).alias(c) for c, n in zip(keep, more)])


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated strings of 100 bytes in all documents."""
    rows = suffix_dedup(plain_names(table(spark, sf_dir, "documents"), ["doc_id", "text"]))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
