"""Benchmark decontamination by edit distance.

Texts and items are reduced to lower-case words with one blank between. An item of m
characters counts as found where a stretch of the text is within RATIO * m edits of it.

Candidates come from CGK walks. A walk reads one character a step and moves on or stays by a
random bit of that character and step, so that two strings few edits apart give outputs few
characters apart. Keys are sampled steps of a walk's output (bit sampling); windows with a key
in common are candidates, whose exact edit distance to the best stretch is then taken, by
bit-parallel columns.

Items of like size form a class. Its windows are walked at every character of the items, but
only at every ``stride``-th of the texts: a copy holds several of those at whatever place it
stands. Walks are added until edited copies at the largest distance allowed are found with
TARGET recall, by the same search; the items of a class that does not get there are held
against every text, without keys.

Items go in blocks of a bounded size, each of which is sent to all tasks and passes over the
documents once. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, written

#: Largest share of an item's characters that may be edited.
RATIO = 0.1
#: Recall asked of rehearsed copies at the largest distance allowed, copies tried, walks at most.
TARGET, TRIALS, MAX_WALKS = 0.99, 1_000, 96
#: Walks taken for each one that the rehearsal needs: what it misses by chance is left for these.
MARGIN = 2
#: Sampled keys of a walk at most; a key holds 16 of its steps, or two thirds of a shorter walk's.
KEYS = 8
#: Least characters of the items of a class; below the first each size is a class, without edits.
CLASSES = (10, 20, 40, 80)
#: Steps of a walk at most.
STEPS = 60
#: Items sent to the tasks at once, and their characters for each (about 100 MB with their keys).
ITEMS, ITEM_CHARS = 1_000, 250
#: Characters that are searched at once, and meetings of keys.
CHARS, PLACES = 1 << 18, 1 << 21

_ODD = np.uint64(0x9E3779B97F4A7C15)
_EVEN = np.uint64(0xC2B2AE3D27D4EB4F)
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    return (key * _ODD >> np.uint64(64 - bits)).astype(np.int64)


def codes(raw: bytes) -> tuple[str, np.ndarray]:
    """A reduced text and one byte for each of its characters; others than ASCII may share one."""
    text = raw.decode("utf-8", "replace")
    if raw.isascii():
        return text, np.frombuffer(raw, np.uint8)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return text, np.where(points < 128, points, 128 | (points ^ points >> np.uint32(7) ^ points >> np.uint32(14)) & 127).astype(np.uint8)


def edit_distance_within(item: str, text: str, most: int) -> tuple[int, int]:
    """Least edit distance of ``item`` to any stretch of ``text``, and that stretch's end; (most + 1, 0) if larger.

    Myers' bit-parallel columns, on one integer of ``len(item)`` bits.
    """
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    up, down, score, best, end = full, 0, m, m, 0
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & full
        plus, minus = (down | ~(diagonal | up)) & full, up & diagonal
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = (minus | ~(diagonal | plus)) & full, plus & diagonal
        if score < best:
            best, end = score, at + 1
    return (best, end) if best <= most else (most + 1, 0)


def edited(text: str, n: int, rng) -> str:
    out = list(text)
    for _ in range(n):
        kind, at = rng.integers(3), int(rng.integers(len(out)))
        if kind == 0:
            out[at] = chr(97 + int(rng.integers(26)))
        elif kind == 1:
            out.insert(at, chr(97 + int(rng.integers(26))))
        elif len(out) > 1:
            del out[at]
    return "".join(out)


class Walks:
    """CGK walks with sampled keys for items of ``least`` characters or more."""

    def __init__(self, least: int):
        self.least, self.steps = least, min(least, STEPS)
        self.stride = max(1, least // 5) if least >= CLASSES[0] else 1
        rng = np.random.default_rng(least)
        self.moves = rng.integers(0, 1 << 62, (MAX_WALKS, 256), dtype=np.int64)
        # a key is two words of a walk, each of up to 8 of its steps; words share no step
        size = max(1, min(8, self.steps // 3))
        self.words = [rng.permutation(self.steps)[: self.steps // size * size].reshape(-1, size) for _ in range(MAX_WALKS)]
        pairs = [(a, b) for a in range(len(self.words[0])) for b in range(a)] or [(0, 0)]
        self.pairs = [[pairs[k] for k in rng.permutation(len(pairs))[:KEYS]] for _ in range(MAX_WALKS)]
        self.walks, self.exact = 1, []
        self.index: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]] = []

    def keys(self, chars: np.ndarray, at: np.ndarray, walk: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Keys of one walk from each place ``at``, and where the walks end; zeros follow the characters."""
        move, out = self.moves[walk][chars], np.empty((self.steps, len(at)), np.uint8)
        place, bit = at.copy(), np.empty(len(at), np.int64)
        for step in range(self.steps):
            if step:
                np.take(move, place, out=bit, mode="clip")
                bit >>= step
                bit &= 1
                place += bit
            np.take(chars, place, out=out[step], mode="clip")
        words = []
        for steps in self.words[walk]:
            word = np.zeros((len(at), 8), np.uint8)
            for k, step in enumerate(steps):
                word[:, k] = out[step]
            words.append(word.view("<u8").ravel())
        keys = [(words[a] * _ODD ^ words[a] >> np.uint64(29)) + words[b] * _EVEN for a, b in self.pairs[walk]]
        return keys, place

    def add(self, coded: list[tuple[int, np.ndarray]]) -> None:
        """Index the windows of ``coded`` items, adding walks until the rehearsal is content; if it
        never is, the items are ``exact`` ones, which have no keys."""
        padding = np.zeros(self.steps, np.uint8)
        chars = np.concatenate([c for _, c in coded] + [padding])
        sizes = np.array([len(c) for _, c in coded])
        begins = np.cumsum(sizes) - sizes
        which = np.repeat(np.arange(len(coded)), sizes)
        at = np.arange(len(which))
        if self.least < CLASSES[0]:
            at, which = begins, np.arange(len(coded))
        owners = np.array([i for i, _ in coded])
        waiting, needed = self._copies(coded), None
        tried = len(waiting)
        for walk in range(MAX_WALKS):
            keys, ends = self.keys(chars, at, walk)
            inside = ends < (begins + sizes)[which]
            self.index.append([_indexed(key[inside], owners[which[inside]], (at - begins[which])[inside]) for key in keys])
            self.walks = walk + 1
            waiting = waiting if needed else [x for x in waiting if not self._found(*x, walk)]
            if needed is None and len(waiting) <= (1 - TARGET) * tried:
                needed = self.walks
            if needed is not None and self.walks >= needed * MARGIN:
                return
        self.walks, self.index, self.exact = 0, [], sorted({i for i, _ in coded})

    def _found(self, item: int, copy: np.ndarray, start: int, most: int, walk: int) -> bool:
        """Whether a key meets the item near its place in the copy."""
        return any((np.abs(place - offset - start)[owner == item] <= most).any() for owner, offset, place in self._met(copy, walk))

    def _copies(self, coded) -> list[tuple[int, np.ndarray, int, int]]:
        """Edited copies of items in turn, each after a few other characters, with its start and edits."""
        rng = np.random.default_rng(7)
        out = []
        for k in range(TRIALS):
            i, chars = coded[k % len(coded)]
            start, most = int(rng.integers(self.stride)), int(RATIO * len(chars))
            copy = "x" * start + edited(chars.tobytes().decode("latin-1"), most, rng)
            out.append((i, np.frombuffer(copy.encode("latin-1"), np.uint8), start, most))
        return out

    def _met(self, chars: np.ndarray, walk: int):
        """Meetings ``(item, place in it, place in chars)`` of one walk's keys, in bounded parts."""
        at = np.arange(0, len(chars), self.stride)
        keys, _ = self.keys(np.append(chars, np.zeros(self.steps, np.uint8)), at, walk)
        for key, (known, owner, offset, marks, bits) in zip(keys, self.index[walk], strict=True):
            slot = _slot(key, bits)
            some = np.flatnonzero(marks[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            low, high = np.searchsorted(known, key[some], "left"), np.searchsorted(known, key[some], "right")
            met = high > low
            place, low, n = at[some[met]], low[met], (high - low)[met]
            total, first = np.cumsum(n), 0
            while first < len(place):
                last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + PLACES, "right")))
                m = n[first:last]
                k = np.repeat(low[first:last] - np.cumsum(m) + m, m) + np.arange(m.sum())
                yield owner[k], offset[k], np.repeat(place[first:last], m)
                first = last

    def meetings(self, chars: np.ndarray):
        for walk in range(self.walks):
            yield from self._met(chars, walk)


def _indexed(key: np.ndarray, owner: np.ndarray, offset: np.ndarray):
    """Keys in order with their items and places in them, and marks of the keys' hashes."""
    order = np.argsort(key, kind="stable")
    bits = max(10, int(16 * len(key)).bit_length())
    marks, slot = np.zeros(1 << bits - 3, np.uint8), _slot(key, bits)
    np.bitwise_or.at(marks, slot >> 3, np.uint8(1) << (slot & 7).astype(np.uint8))
    return key[order], owner[order].astype(np.int32), offset[order].astype(np.int32), marks, bits


class Items:
    """A block of items with the keys of their walks."""

    def __init__(self, rows: list[tuple[int, str]], ratio: float = RATIO):
        found = [(i, b" ".join(words_of(t))) for i, t in rows]
        found = [(i, r) for i, r in found if r]
        self.ids = [i for i, _ in found]
        coded = [codes(r) for _, r in found]
        self.texts = [t for t, _ in coded]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.most = np.array([int(ratio * len(t)) for t in self.texts], np.int64)
        classes: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, (_, chars) in enumerate(coded):
            least = max((c for c in CLASSES if c <= len(chars)), default=len(chars))
            classes.setdefault(least, []).append((i, chars))
        self.walks = []
        for least, some in sorted(classes.items()):
            self.walks.append(Walks(least))
            self.walks[-1].add(some)

    def _windows(self, chars: np.ndarray, starts: np.ndarray):
        """Stretches ``(text, item, from, to)`` of joined texts that may hold an item; ``starts``: where texts begin."""
        most = int(self.sizes.max())
        bins = len(chars) + most + 2  # more than there are bins of a start
        keys = []
        for walks in self.walks:
            for item, offset, where in walks.meetings(chars):
                text = np.searchsorted(starts, where, "right") - 1
                start = where - starts[text] - offset + most
                # of an item without edits one place in a text stands for all
                bin_ = np.where(self.most[item] == 0, 0, start // (self.most[item] + 1))
                keys.append(np.unique((text * len(self.ids) + item) * bins + bin_))
        ends = np.append(starts[1:] - 1, len(chars))
        for item in (i for walks in self.walks for i in walks.exact):
            yield from ((text, item, int(begin), int(end)) for text, (begin, end) in enumerate(zip(starts, ends, strict=True)) if end > begin)
        if not keys:
            return
        key = np.unique(np.concatenate(keys))
        heads = np.flatnonzero(np.append(True, np.diff(key) > 1))  # bins side by side are one stretch
        tails = np.append(heads[1:], len(key)) - 1
        for x, y in zip(key[heads].tolist(), key[tails].tolist(), strict=True):
            width = y - x + 1
            x, bin_ = divmod(x, bins)
            text, item = divmod(x, len(self.ids))
            begin, end, k = int(starts[text]), int(ends[text]), int(self.most[item])
            if k:
                # insertions and deletions before the window moved it by k at most
                start = begin + bin_ * (k + 1) - most
                end = min(end, start + width * (k + 1) + int(self.sizes[item]) + 2 * k)
                begin = max(begin, start - k)
            yield text, item, begin, end

    def leaks(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """For each text its leaked items, as (item id, least edit distance)."""
        out: list[dict[int, int]] = [{} for _ in texts]
        if not self.ids:
            return [[] for _ in texts]
        first = 0
        while first < len(texts):
            raws, size, last = [], 0, first
            while last < len(texts) and size < CHARS:
                raws.append(b" ".join(words_of(texts[last])))
                size += len(raws[-1]) + 1
                last += 1
            joined, chars = codes(b"\0".join(raws))
            starts = np.append(0, np.flatnonzero(chars == 0) + 1)
            done: dict[tuple[int, int], int] = {}  # where the stretch tried last ended
            for text, i, begin, end in self._windows(chars, starts):
                found, most, item = out[first + text], int(self.most[i]), self.texts[i]
                if found.get(self.ids[i], 1) == 0:
                    continue
                if done.get((text, i), -1) >= end:
                    continue
                done[text, i] = end
                stretch = joined[begin:end]
                distance = 0 if item in stretch else edit_distance_within(item, stretch, most)[0] if most else 1
                if distance <= most:
                    found[self.ids[i]] = min(distance, found.get(self.ids[i], distance))
            first = last
        return [sorted(x.items()) for x in out]


def blocks(benchmark: DataFrame, size: int = ITEMS) -> Iterator[tuple[Items, bool]]:
    """Items of ``benchmark(item_id, text)`` in blocks, and whether the block is the only one.

    Null ids and texts, and items without a letter or digit, are left out; of a repeated id
    every text counts. The driver holds one block at a time.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null").distinct()
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(-(-n // size), -(-chars // (size * ITEM_CHARS)))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, parts))))
    if parts > 1:
        dealt = written(dealt)
    for k in range(parts):
        yield Items(sorted((r["item_id"], r["text"]) for r in dealt.filter(F.col("part") == k).collect())), parts == 1


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, distance`` for each document of ``docs(doc_id, text)`` and item found in it
    at an edit distance of at most RATIO of the item's length.

    Null and empty texts leak nothing. Repeated rows each give their rows, null ids stay null;
    other columns are not read. Without items or documents the result is empty. With several
    blocks of items each one's rows are written before the next block is fetched.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shape = "doc_id long, item_id long, distance int"
    out = None
    for items, only in blocks(benchmark):
        found = rows.mapInArrow(_leaks(items), shape)
        if not only:
            found = written(found)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else rows.sparkSession.createDataFrame([], shape)


def _leaks(items: Items):
    def run(batches):
        for batch in sliced(batches):
            found = items.leaks(batch.column("text").to_pylist())
            rows = [(d, i, n) for d, f in zip(batch.column("doc_id").to_pylist(), found, strict=True) for i, n in f]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "distance"])

    return run


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns.

    Null and empty texts stay; repeated rows stay or go together, whatever their ids.
    """
    place = docs.columns.index("text")
    for items, only in blocks(benchmark):
        docs = docs.mapInArrow(_clean(items, place), docs.schema)
        if not only:
            docs = written(docs)
    return docs


def _clean(items: Items, place: int):
    def run(batches):
        for batch in sliced(batches):
            found = items.leaks([t or "" for t in batch.column(place).to_pylist()])
            yield batch.filter(pa.array([not f for f in found], pa.bool_()))

    return run
