"""Encoding with a public byte-level BPE tokenizer.

A text is cut into pre-tokens by the tokenizer's pattern; each pre-token's bytes are merged by rank. The merges wait in a queue of
buckets, one per rank, each a list of positions in the linked list of parts; a hierarchical bitmap over the ranks tells the
next non-empty bucket by find-first-set at each level. Entries whose pair has changed since are stale and skipped. A
pre-token of n bytes takes on the order of n steps, so one of a million characters does no harm.

Null and empty texts give an empty list. Strings of special tokens are ordinary text. The vocabulary files stay where
they are; their folder is a parameter.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens kept with their ids per worker; beyond this many the store starts anew. It speeds up, and decides nothing.
REMEMBERED = 200_000
VOCABULARY = "byte_bpe_50k"


class RankQueue:
    """Ranks with waiting entries, as bits in a tree of 64-bit words."""

    def __init__(self, size: int):
        self.levels: list[dict[int, int]] = []
        while True:
            self.levels.append({})
            if size <= 64:
                break
            size = (size + 63) // 64
        self.buckets: dict[int, list] = {}
        #: The lowest rank pushed since the last pop.
        self.lowest = 1 << 62

    def push(self, rank: int, entry) -> None:
        if rank < self.lowest:
            self.lowest = rank
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(entry)
            return
        self.buckets[rank] = [entry]
        for level in self.levels:
            word = rank >> 6
            before = level.get(word, 0)
            level[word] = before | (1 << (rank & 63))
            if before:
                return
            rank = word

    def pop(self) -> tuple[int, list] | None:
        """The lowest rank and its whole bucket."""
        self.lowest = 1 << 62
        if not self.buckets:
            return None
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            at = (at << 6) | ((word & -word).bit_length() - 1)
        rank, bit = at, at
        for level in self.levels:
            word = bit >> 6
            left = level[word] & ~(1 << (bit & 63))
            if left:
                level[word] = left
                break
            del level[word]
            bit = word
        return rank, self.buckets.pop(rank)


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.size = max(ranks.values()) + 1
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for piece in self.pattern.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "replace"))
                if len(piece) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out

    def merge(self, data: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        # Part k spans data[k:after[k]]; before and after link the parts, 0 in alive marks a part that was taken in.
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\x01" * n)
        queue = RankQueue(self.size)
        for k in range(n - 1):
            rank = ranks.get(data[k : k + 2])
            if rank is not None:
                queue.push(rank, (k, k + 2))
        while (top := queue.pop()) is not None:
            rank, entries = top
            # Of one rank, the leftmost goes first.
            entries.sort()
            for place, (k, end) in enumerate(entries):
                if queue.lowest < rank:
                    # A merge made a pair of lower rank: it goes first, the rest of this bucket waits.
                    for entry in entries[place:]:
                        queue.push(rank, entry)
                    break
                middle = after[k] if alive[k] else n
                if not alive[k] or middle >= n or after[middle] != end:
                    continue
                alive[middle] = 0
                after[k] = end
                if end < n:
                    before[end] = k
                    right = ranks.get(data[k : after[end]])
                    if right is not None:
                        queue.push(right, (k, after[end]))
                left = before[k]
                if left >= 0:
                    other = ranks.get(data[left:end])
                    if other is not None:
                        queue.push(other, (left, end))
        ids, k = [], 0
        while k < n:
            ids.append(ranks[data[k : after[k]]])
            k = after[k]
        return ids


def _folder(folder: str | None) -> tuple[str, str]:
    """The folder of the files and the pattern that belongs to them."""
    import public_tokenizers

    return folder or os.path.dirname(public_tokenizers.path(f"{VOCABULARY}.tiktoken")), public_tokenizers.PATTERN


@functools.cache
def encoder(name: str = VOCABULARY, folder: str | None = None) -> Encoder:
    """One per worker: ranks from the file of lines ``base64 rank``."""
    where, pattern = _folder(folder)
    with open(os.path.join(where, f"{name}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return Encoder(ranks, pattern)


def encoded(df: DataFrame, key: str, text: str, name: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """doc_id, ids of every row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(name, folder)
        for batch in batches:
            texts = batch.column("__text")
            ids = pa.array([one.encode(x.as_py()) for x in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("__text"))
    return rows.mapInArrow(encode, "doc_id bigint, ids array<int>")
