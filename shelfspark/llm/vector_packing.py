"""Packing examples into sequences: vector bin packing by the dot-product heuristic, under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import base64
import contextlib
import json
from collections import deque
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, blobs, plain_names, sliced, table

#: Items that wait for a place in a task: beyond so many sequences' worth, sequences are closed.
POOL = 96


@lru_cache(maxsize=2)
def _fast(json_path: str, rank_path: str):
    """The rank file's encoder, and the strings of special tokens."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(rank_path, "rb"))}
    special = [t["content"] for t in json.load(open(json_path, encoding="utf-8"))["added_tokens"]]
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), special


@lru_cache(maxsize=2)
def _slow(json_path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


def encode(text: str, json_path: str, rank_path: str) -> np.ndarray:
    """Ids of the vocabulary file json_path. The rank file holds the same vocabulary and is quicker to apply; a text with the string of a special token goes to the vocabulary file itself, which is loaded only then. So does one whose pattern the quick encoder can't match for want of stack, such as a million blanks in a row."""
    fast, special = _fast(json_path, rank_path)
    if not any(s in text for s in special):
        with contextlib.suppress(ValueError):
            return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
    return np.array(_slow(json_path).encode(text, add_special_tokens=False).ids, dtype="<u4")


class Packer:
    """Sequences under limits (tokens, segments, loss-bearing tokens); items are (key, start, ids, loss mask or None).

    The open sequence takes, among the items that fit in every dimension, the one of greatest dot product of its
    demand and what is left, both as shares of the limits; equal demands are taken in the order they came. Where none
    fits and cut is true, the item of greatest dot product is cut to what is left, if that is at least least_cut
    tokens; its other part waits on. Items of equal demand wait in one queue, so a placement costs as many steps as
    there are different demands, however many items wait.
    """

    def __init__(self, limits: tuple[int, int, int], cut: bool = True, least_cut: int = 8):
        self.limits = np.array(limits, dtype=np.float64)
        self.limit, self.cut, self.least_cut = limits, cut, least_cut
        self.queue: dict[tuple[int, int], deque] = {}
        self.waiting = 0
        self.next = 0

    def _put(self, key, start: int, ids: np.ndarray, loss: np.ndarray | None) -> None:
        need = len(ids), len(ids) if loss is None else int(loss.sum())
        self.queue.setdefault(need, deque()).append((key, start, ids, loss))
        self.waiting += len(ids)

    def add(self, key, ids: np.ndarray, loss: np.ndarray | None = None) -> None:
        """Texts above the limits are cut into whole sequences; what is left of them is one item."""
        at = 0
        while at < len(ids):
            n = self._most(len(ids), loss, at, *[self.limit[k] for k in (0, 2)])
            self._put(key, at, ids[at : at + n], None if loss is None else loss[at : at + n])
            at += n

    @staticmethod
    def _most(total: int, loss, at: int, tokens: int, bearing: int) -> int:
        """The longest piece from `at` within so many tokens and loss-bearing tokens, at least one token."""
        n = min(tokens, total - at)
        if loss is not None and loss[at : at + n].sum() > bearing:
            n = int(np.searchsorted(np.cumsum(loss[at : at + n]), bearing, "right"))
        elif loss is None:
            n = min(n, bearing)
        return max(1, int(n))

    def drain(self, keep_tokens: int):
        """Closes sequences while more than keep_tokens wait; yields (sequence number, offset, key, start, ids, loss)."""
        demands = None
        while self.waiting > keep_tokens:
            left, offset = self.limits.copy(), 0
            while True:
                if demands is None:
                    demands = list(self.queue)
                    need = np.array([(n, 1, m) for n, m in demands], dtype=np.float64).reshape(-1, 3)
                    share = need / self.limits
                if not demands:
                    break
                fits, score, cut_to = (need <= left).all(axis=1), share @ (left / self.limits), 0
                if fits.any():
                    at = int(np.where(fits, score, -1.0).argmax())
                elif self.cut and left[1] >= 1 and min(left[0], left[2]) >= self.least_cut:
                    at = int(score.argmax())
                    cut_to = 1
                else:
                    break
                held = self.queue[demands[at]]
                key, start, ids, loss = held.popleft()
                self.waiting -= len(ids)
                if not held:
                    del self.queue[demands[at]]
                    demands = None
                if cut_to:
                    n = self._most(len(ids), loss, 0, int(left[0]), int(left[2]))
                    self._put(key, start + n, ids[n:], None if loss is None else loss[n:])
                    ids, loss, demands = ids[:n], None if loss is None else loss[:n], None
                yield self.next, offset, key, start, ids, loss
                offset += len(ids)
                left -= (len(ids), 1, len(ids) if loss is None else loss.sum())
                if left[0] < 1 or left[1] < 1:
                    break
            if not offset:
                raise ValueError("an item can't fit an empty sequence")
            self.next += 1


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, tokens: int = 2048, segments: int = 64, loss_tokens: int | None = None, end_id: int = 1, json_path: str | None = None, rank_path: str | None = None, cut: bool = True) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset, loss_tokens): every id of every document in exactly one piece.

    ids holds little-endian unsigned 32-bit ids. A document is its prompt's ids, if there is a prompt column, which bear
    no loss, then its text's ids and end_id, which do; loss_tokens counts those of the piece. A null prompt is empty.
    A null or empty text is end_id alone; a text above the limits is cut, however long; repeated rows are packed each.
    Each task packs its own part of the table and holds POOL sequences' worth of ids at most besides one slice of
    texts; sequence_id is the part's number and a count. No rows give no rows; null ids are packed like others.
    """
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    rank_path = rank_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    limits = (tokens, segments, loss_tokens or tokens)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        packer, names, id_type = Packer(limits, cut), None, None

        def rows(pieces):
            out = list(pieces)
            keys = [x[2] for x in out]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in keys], id_type), pa.array([x[3] for x in out], pa.int64()), pa.array([len(x[4]) for x in out], pa.int64()), pa.array([x[4].tobytes() for x in out], pa.binary()),
                    pa.array([n for _, n in keys], pa.int64()), pa.array([part + x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()),
                    pa.array([len(x[4]) if x[5] is None else int(x[5].sum()) for x in out], pa.int64()),
                ],
                names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "loss_tokens"],
            )

        for batch in sliced(batches, 1):
            id_type = batch.column(0).type
            prompts = blobs(batch.column(2)) if prompt_col else repeat(None)
            for key, text, prompt in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), prompts):
                ids = [encode(text.decode("utf-8", "replace"), json_path, rank_path), np.array([end_id], "<u4")]
                if prompt is not None:
                    ids.insert(0, encode(prompt.decode("utf-8", "replace"), json_path, rank_path))
                loss = None if prompt is None else np.arange(sum(map(len, ids))) >= len(ids[0])
                ids = np.concatenate(ids).astype("<u4", copy=False)
                packer.add((key, len(ids)), ids, loss)
            yield rows(packer.drain(POOL * tokens))
        if packer.waiting:
            yield rows(packer.drain(0))

    cols = docs.select(F.col(f"`{id_col}`"), *[F.col(f"`{c}`").cast("binary").alias(n) for c, n in ((text_col, "__text"), (prompt_col, "__prompt")) if c])
    return cols.transform(arrow_map, run, f"`{id_col}` {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, loss_tokens bigint")


def op8_vector_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    packed = pack(plain_names(table(spark, sf_dir, "documents"), ["doc_id", "text"]))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
