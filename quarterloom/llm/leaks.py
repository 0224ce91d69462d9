"""Passages of held-out evaluation items inside a training corpus, whole or in part.

Texts and items are words without case and punctuation (module wordruns). Runs of words that few of the items' texts have are
seeds; a document that shares enough seeds with an item, close to one diagonal, is a candidate, and Smith-Waterman alignment of
words scores it: copies with changed, lost or inserted words align, passages that are only worded alike don't. A document
holds an item if some part of the alignment matches at least two fifths of the item's words, and at least ``FEWEST``, and is matched to
``ALIKE`` or more.

The seeds lose nothing: how many an item needs follows from its own length and seeds, as the least number that any such stretch must
still share after as many edits as ``ALIKE`` allows. Rarity is counted over distinct item texts, so repeated items keep their
seeds; where an item's rare runs can't promise a seed in every stretch, its commoner runs are taken as well, rarest first. Items of
12 words or fewer go by runs of two words, others by runs of three.

A document's seeds are gathered within its row, so no document is shuffled. The items go to the tasks in blocks of
a checked size; more blocks mean more passes over the documents, not more memory, and the result is the same for
any number of blocks. Long documents are searched whole. Null and empty texts and items hold nothing; items of fewer than ``FEWEST``
words are never found (a shorter stretch is a quotation). Items with the same text are all found, each under its id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterloom.llm.wordruns import Words, runs, words

SHARE, ALIKE = 0.4, 0.8
#: Words a stretch must match at the least, whatever the item's length.
FEWEST = 4
#: A run of words is rare if at most so many distinct item texts have it. An item takes commoner runs too, rarest first, until every
#: stretch is sure to share this part of the seeds that all its runs would promise.
RARE, SURE = 4, 0.75
#: An edit costs less than a match pays, so that an alignment goes on over single edits up to a part's last word; what is alike
#: enough is taken out of it afterwards.
MATCH, MISMATCH, GAP = 4, -3, -4
#: Cells of the alignment tables that are worked out side by side.
TABLE = 4_000_000
#: Bytes of item texts in one block.
BLOCK = 16_000_000


def _least(size: int) -> int:
    """Words of an item of this size that a stretch must match."""
    return max(FEWEST, -(-size * 2 // 5))


def _run_size(size: int) -> int:
    return 2 if size <= 12 else 3


def promised(chosen: np.ndarray, size: int) -> int:
    """Seeds that any stretch of an item shares, however its edits fall. chosen: which of the item's runs are seeds.

    A stretch matches M words and has at most E = M(1 - ALIKE) / ALIKE edits. One that changes or loses a word of the item spoils as
    many runs as a run has words, but lengthens the item's part of the stretch; an inserted word spoils one less.
    """
    least, run = _least(size), _run_size(size)
    edits = int(np.ceil(least * (1 - ALIKE) / ALIKE - 1e-9))
    before = np.concatenate([[0], np.cumsum(chosen)])
    best = None
    for inner in range(edits + 1):
        width = min(least + inner, size) - run + 1
        if width <= 0:
            return 0
        fewest = int((before[width:] - before[:-width]).min()) - run * inner - (run - 1) * (edits - inner)
        best = fewest if best is None else min(best, fewest)
        if least + inner >= size:
            break
    return best


class Items:
    """The distinct texts of items as word numbers, with their seeds."""

    def __init__(self, items: list[tuple[int, str | None]], rare: int = RARE):
        said = words([text for _, text in items])
        texts: dict[bytes, int] = {}
        self.keys: list[list[int]] = []
        self.words: list[np.ndarray] = []
        for row, (key, _) in enumerate(items):
            own = said.of(row)
            if len(own) >= FEWEST:
                number = texts.setdefault(own.tobytes(), len(self.words))
                if number == len(self.words):
                    self.words.append(own)
                    self.keys.append([])
                self.keys[number].append(key)
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        all_runs = [runs(w, _run_size(len(w))) for w in self.words]
        distinct = [np.unique(r) for r in all_runs]
        names, times = np.unique(np.concatenate([*distinct, np.zeros(0, np.uint64)]), return_counts=True)
        self.least = np.ones(len(self.words), np.int64)
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {2: [], 3: []}
        for number, own in enumerate(all_runs):
            common = times[np.searchsorted(names, own)]
            enough = max(1, SURE * promised(np.ones(len(own), bool), len(self.words[number])))
            for level in [rare, *np.unique(common[common > rare]).tolist()]:
                chosen = common <= level
                if (sure := promised(chosen, len(self.words[number]))) >= enough:
                    break
            self.least[number] = max(1, sure)
            at = np.flatnonzero(chosen)
            found[_run_size(len(self.words[number]))].append((own[at], np.full(len(at), number), at))
        self.seeds = {size: _Seeds(parts) for size, parts in found.items() if parts}

    def candidates(self, texts: Words) -> Iterator[tuple[int, int, int, int]]:
        """(row, item text, first and last word) of the stretches that share enough seeds near one diagonal."""
        rows, places, numbers, at = [], [], [], []
        for size, seeds in self.seeds.items():
            spots, which, item, pos = seeds.meet(runs(texts.hashes, size))
            row = np.searchsorted(texts.starts, spots, side="right") - 1
            # A run across two texts is none.
            whole = spots + size <= texts.starts[row + 1]
            rows.append(row[whole])
            places.append((spots - texts.starts[row])[whole])
            numbers.append(item[whole])
            at.append(pos[whole])
        if not rows or not sum(map(len, rows)):
            return
        row, place, number, pos = (np.concatenate(x) for x in (rows, places, numbers, at))
        # Pairs with too few seeds in all go before anything is put in order.
        pair = row * len(self.words) + number
        _, which, many = np.unique(pair, return_inverse=True, return_counts=True)
        enough = (many >= self.least[number[np.unique(pair, return_index=True)[1]]])[which]
        row, number, pos, way = row[enough], number[enough], pos[enough], (place - pos)[enough]
        if not len(row):
            return
        order = np.lexsort((way, number, row))
        row, number, way, pos = row[order], number[order], way[order], pos[order]
        # In a stretch of just enough words, lost and inserted ones move the diagonal by no more than its edits, and its seeds lie
        # within its part of the item. (A longer stretch has such a part, or is of exact pieces on both sides of its edits.)
        need = np.array([_least(n) for n in self.sizes])
        drift = np.ceil(need * (1 - ALIKE) / ALIKE).astype(np.int64) + 1
        fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (number[1:] != number[:-1]) | (way[1:] - way[:-1] > drift[number[1:]])])
        begin = np.flatnonzero(fresh)
        end = np.concatenate([begin[1:], [len(row)]])
        full = end - begin >= self.least[number[begin]]
        for a, b in zip(begin[full], end[full], strict=True):
            item = int(number[a])
            least, own = int(self.least[item]), np.unique(pos[a:b])
            if len(own) >= least and (own[least - 1 :] - own[: len(own) - least + 1] <= need[item] + drift[item]).any():
                slack = int(np.ceil(self.sizes[item] * (1 - ALIKE) / ALIKE))
                yield int(row[a]), item, max(0, int(way[a]) - slack), int(way[b - 1]) + int(self.sizes[item]) + slack

    def found(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, float]]:
        """(row, item, share of the item's words held, how alike the stretch is) of every item each text holds."""
        said = words(texts)
        best: dict[tuple[int, int], tuple[float, float]] = {}
        near = list(self.candidates(said))
        scored = held_all([(said.of(row)[first:last], self.words[item]) for row, item, first, last in near])
        for (row, item, _, _), (share, alike) in zip(near, scored, strict=True):
            if share and (share, alike) > best.get((row, item), (0.0, 0.0)):
                best[row, item] = share, alike
        for (row, item), (share, alike) in best.items():
            for key in self.keys[item]:
                yield row, key, share, alike


class _Seeds:
    """Seed hashes in order, with the places each has in the items."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        hashes, item, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(hashes, kind="stable")
        self.item, self.pos = item[order], pos[order]
        self.names, self.first, self.many = np.unique(hashes[order], return_index=True, return_counts=True)
        # Most runs of a corpus are no seeds and end at this table of their upper bits.
        self.shift = np.uint64(64 - max(16, int(len(self.names)).bit_length() + 5))
        self.maybe = np.zeros(1 << (64 - int(self.shift)), bool)
        self.maybe[(self.names >> self.shift).astype(np.int64)] = True

    def meet(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place among the hashes, seed, item, place in the item) of every meeting."""
        spots = np.flatnonzero(self.maybe[(hashes >> self.shift).astype(np.int64)])
        seed = np.minimum(np.searchsorted(self.names, hashes[spots]), max(0, len(self.names) - 1))
        same = self.names[seed] == hashes[spots] if len(self.names) else np.zeros(0, bool)
        spots, seed = spots[same], seed[same]
        many = self.many[seed]
        each = np.repeat(self.first[seed] - np.concatenate([[0], np.cumsum(many)[:-1]]) if len(seed) else seed, many) + np.arange(int(many.sum()))
        return np.repeat(spots, many), np.repeat(seed, many), self.item[each], self.pos[each]


def held(text: np.ndarray, item: np.ndarray) -> tuple[float, float]:
    """The best local alignment's longest part that is alike enough: matched words as a share of the item's, and of the part.
    (0, 0) if no part is long enough."""
    return next(iter(held_all([(text, item)])))


def held_all(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, float]]:
    """``held`` of many pairs of about the same size at once.

    A long text is aligned in windows that overlap by more than any alignment can span (a gap costs what a match
    pays, so an alignment spans at most twice the item); the tables stay small.
    """
    out = [(0.0, 0.0)] * len(pairs)
    tasks: list[tuple[int, np.ndarray, np.ndarray]] = []
    for number, (text, item) in enumerate(pairs):
        span = 2 * len(item) + 1
        if len(text) > 4 * span:
            tasks += [(number, text[at : at + 2 * span], item) for at in range(0, len(text) - span, span)]
        elif len(text) and len(item):
            tasks.append((number, text, item))
    tasks.sort(key=lambda t: len(t[1]) * len(t[2]))
    at = 0
    while at < len(tasks):
        size, end = 0, at
        n = m = 0
        while end < len(tasks):
            n, m = max(n, len(tasks[end][1])), max(m, len(tasks[end][2]))
            if end > at and (end + 1 - at) * (n + 1) * (m + 1) > TABLE:
                break
            end += 1
        for (number, _, item), found in zip(tasks[at:end], _aligned([t[1:] for t in tasks[at:end]]), strict=True):
            out[number] = max(out[number], found)
        at = end
    return out


def _aligned(pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, float]]:
    """Smith-Waterman tables of all pairs side by side, then the way back through each."""
    n, m = max(len(t) for t, _ in pairs), max(len(i) for _, i in pairs)
    texts, items = np.zeros((n, len(pairs), 1), np.uint64), np.ones((len(pairs), m), np.uint64)
    for k, (text, item) in enumerate(pairs):
        # Filling on either side equals nothing.
        texts[: len(text), k, 0], items[k, : len(item)] = text | np.uint64(2), item | np.uint64(2)
    table = np.zeros((n + 1, len(pairs), m + 1), np.int32)
    slope = np.arange(m + 1, dtype=np.int32) * -GAP
    for i in range(1, n + 1):
        row, last = table[i], table[i - 1]
        np.maximum(last[:, :-1] + np.where(items == texts[i - 1], np.int32(MATCH), np.int32(MISMATCH)), last[:, 1:] + np.int32(GAP), out=row[:, 1:])
        np.maximum(row, 0, out=row)
        # Gaps along the row: the best of all earlier cells less the way.
        np.maximum(row, np.maximum.accumulate(row + slope, axis=1) - slope, out=row)
    for k, (text, item) in enumerate(pairs):
        own = table[:, k]
        least = _least(len(item))
        i, j = divmod(int(own.argmax()), m + 1)
        # No stretch that matches enough scores less.
        if own[i, j] < MATCH * least + GAP * least * (1 - ALIKE) / ALIKE:
            yield 0.0, 0.0
            continue
        columns: list[int] = []
        while i and j and own[i, j] > 0:
            same = text[i - 1] == item[j - 1]
            if own[i, j] == own[i - 1, j - 1] + (MATCH if same else MISMATCH):
                columns.append(int(same))
                i, j = i - 1, j - 1
            else:
                columns.append(0)
                if own[i, j] == own[i - 1, j] + GAP:
                    i -= 1
                else:
                    j -= 1
        matched, size = _alike_part(np.array(columns, np.int64))
        yield (matched / len(item), matched / size) if matched >= least else (0.0, 0.0)


def _alike_part(columns: np.ndarray) -> tuple[int, int]:
    """Matches and columns of the part of an alignment that matches most while it is matched to ALIKE or more."""
    matched = np.concatenate([[0], np.cumsum(columns)])
    # A part is alike enough if its surplus isn't negative; the farthest start with no more surplus than its end is best.
    surplus = matched - ALIKE * np.arange(len(matched)) + 1e-9 * np.arange(len(matched))
    lowest = np.minimum.accumulate(surplus)
    start = np.searchsorted(-lowest, -surplus)
    gain = matched - matched[start]
    end = int(gain.argmax())
    return int(gain[end]), int(end - start[end]) or 1


_FOUND = "doc_id bigint, item_id bigint, share double, alike double"
_KINDS = (pa.int64(), pa.int64(), pa.float64(), pa.float64())


def _searched(shared) -> object:
    """The search over batches; the items' seeds are built once where a task runs."""
    ready: list[Items] = []

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not ready:
                ready.append(Items(shared.value))
            ids = batch.column("doc_id")
            for at in range(0, batch.num_rows, 500):
                rows = [(ids[at + row].as_py(), *one) for row, *one in ready[0].found(batch.column("__text").slice(at, 500).to_pylist())]
                columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=["doc_id", "item_id", "share", "alike"])

    return search


def leaked(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, share, alike of every document and item held in it. block: bytes of item texts that go to the tasks at once."""
    context = documents.sparkSession.sparkContext
    rows = documents.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("__text"))
    tests = items.select(F.col(f"`{item_key}`").cast("bigint").alias("item_id"), F.col(f"`{item_text}`").alias("item_text")).where("item_id is not null and length(item_text) > 0")
    size = tests.agg(F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block))
    out = None
    for number in range(blocks):
        part = tests.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).select("item_id", "item_text")
        shared = context.broadcast(sorted((r.item_id, r.item_text) for r in part.collect()))
        found = rows.mapInArrow(_searched(shared), _FOUND)
        out = found if out is None else out.unionByName(found)
    return out
