"""Exact removal of repeated byte strings, by content-defined anchors.

In place of radix passes over all suffixes, which would move a record for every byte, strings of
``DEPTH`` bytes are told apart in three steps that keep equal strings together, each settling
most of what it gets:

* By the hash of the string's *anchor*, the least of the 50-byte grams inside it. Equal strings
  have equal anchors at equal distances, and neighbouring strings share theirs, so one record
  (anchor, digest of the stretch its strings cover) stands for some 75 strings. Anchors that
  occur once are settled: no string over them repeats.
* By the digest of the whole stretch. Strings whose stretches are equal are repeated, however
  many there are; the rest keeps one record a distinct stretch.
* Only where an anchor has different stretches: by hashes of every full string over it, compared
  anchor by anchor inside tasks; those of an anchor of very many stretches are grouped across
  all tasks instead. Either way every string is compared.

Strings count as equal if 64-bit hashes of all their bytes and of their anchor are. The removed
bytes are the union of the repeated strings. What is joined with texts is a list of spans for
each document. The tables in between are deleted when the result is written.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cuts, keyed, shuffle_parts, sliced, written

DEPTH = 200
GRAM = 50
WINDOW = DEPTH - GRAM + 1
#: Bytes hashed at once; longer texts go in pieces that overlap by DEPTH - 1.
BUFFER = 1 << 17
_BITS = 18
#: Distinct stretches of one anchor beyond which they are compared across tasks.
HOT = 20_000

_rng = np.random.Generator(np.random.PCG64(77))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(0, 1 << 62)) * 4 + 1
_SIZE = 2 * BUFFER + DEPTH


def _powers(base: int) -> np.ndarray:
    out = np.full(_SIZE + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _sums(raw: bytes) -> np.ndarray:
    """Prefix sums from which the hash of any stretch follows."""
    c = _BYTE[np.frombuffer(raw, np.uint8)]
    c *= _POWER[: len(c)]
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(c, dtype=np.uint64)])


def _hashes(sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the stretches from ``first`` to ``last`` (exclusive)."""
    return _mixed((sums[last] - sums[first]) * _INVERSE[first] + (last - first).astype(np.uint64))


def _window_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    return _mixed((sums[width:] - sums[:-width]) * _INVERSE[: len(sums) - width] + np.uint64(width))


def _pieces(texts: list[bytes]):
    """Buffers of (text number, offset in it, bytes): every string start is in one of them."""
    buffer, size = [], 0
    for i, raw in enumerate(texts):
        for at in range(0, max(0, len(raw) - DEPTH + 1), BUFFER):
            part = raw[at : at + BUFFER + DEPTH - 1]
            if size and size + len(part) > BUFFER:
                yield buffer
                buffer, size = [], 0
            buffer.append((i, at, part))
            size += len(part)
    if buffer:
        yield buffer


def anchors(texts: list[bytes]):
    """Arrays ``text number, anchor hash, stretch digest, first start, starts``, in turn for each buffer."""
    for buffer in _pieces(texts):
        raw = b"".join(p for _, _, p in buffer)
        lengths = np.array([len(p) for _, _, p in buffer])
        begins = np.cumsum([0, *lengths[:-1]])
        sums = _sums(raw)
        grams = _window_hashes(sums, GRAM)
        v = ((grams >> np.uint64(_BITS + 1)) << np.uint64(_BITS)).view(np.int64) | np.arange(len(grams))
        width = 1
        while width * 2 <= WINDOW:  # least of width, twice width, ... neighbours
            v = np.minimum(v[:-width], v[width:])
            width *= 2
        v = np.minimum(v[: len(v) - (WINDOW - width)], v[WINDOW - width :])
        at = v & ((1 << _BITS) - 1)
        piece = np.repeat(np.arange(len(buffer)), lengths - DEPTH + 1)
        starts = np.arange(len(piece)) + piece * (DEPTH - 1)  # valid starts: all but each piece's last DEPTH - 1
        at = at[starts]
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])]))
        count = np.diff(np.append(new, len(at)))
        first = starts[new]
        digest = _hashes(sums, first, first + count + DEPTH - 1) + (at[new] - first).astype(np.uint64)
        owner = piece[new]
        yield np.array([i for i, _, _ in buffer])[owner], grams[at[new]], digest, first - begins[owner] + np.array([o for _, o, _ in buffer])[owner], count


def _occurrences(batches):
    for batch in sliced(batches):
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        for owner, gram, digest, first, count in anchors(texts):
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(keys[owner], pa.int64()), pa.array(first * 256 + count, pa.int64())],
                ["anchor", "stretch", "key", "place"],
            )  # place: first start, and how many starts (at most WINDOW)


def _stretches(batches):
    """The bytes of the wanted stretches of each text."""
    for batch in sliced(batches):
        out = {name: [] for name in ("anchor", "stretch", "times", "key", "first", "bytes")}
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            for w in wanted:
                first, count = w["place"] >> 8, w["place"] & 255
                for name, value in (("anchor", w["anchor"]), ("stretch", w["stretch"]), ("times", w["times"]), ("key", w["key"]), ("first", first), ("bytes", raw[first : first + count + DEPTH - 1])):
                    out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("anchor", pa.int64()), ("stretch", pa.int64()), ("times", pa.int64()), ("key", pa.int64()), ("first", pa.int64()), ("bytes", pa.binary())]))


def _strings(stretches: list[bytes]):
    """Hashes of all strings of the stretches, the stretch of each, and its start in it."""
    hashes, owner, start = [], [], []
    done = 0
    while done < len(stretches):
        last, size = done, 0
        while last < len(stretches) and size + len(stretches[last]) <= BUFFER:
            size += len(stretches[last])
            last += 1
        lengths = np.array([len(s) for s in stretches[done:last]])
        h = _window_hashes(_sums(b"".join(stretches[done:last])), DEPTH)
        own = np.repeat(np.arange(last - done), lengths - DEPTH + 1)
        at = np.arange(len(own)) + own * (DEPTH - 1)
        hashes.append(h[at])
        owner.append(own + done)
        start.append(at - np.cumsum([0, *lengths[:-1]])[own])
        done = last
    return np.concatenate(hashes), np.concatenate(owner), np.concatenate(start)


_SPANS = "key long, first long, last long"


def _spans(key: list, first: list, last: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["key", "first", "last"])


def _compared(batches):
    """Rows in order of their anchor: spans of the strings that some other start repeats."""
    kept = None
    for batch in _with_end(batches):
        if batch is not None:
            table = pa.Table.from_batches([batch] if kept is None else [*kept.to_batches(), batch])
            of = table.column("anchor").to_numpy()
            cut = int(np.flatnonzero(of != of[-1])[-1]) + 1 if len(of) and of[0] != of[-1] else 0
            kept, table = table.slice(cut).combine_chunks(), table.slice(0, cut)
        else:
            table = kept
        if table is not None and len(table):
            yield _repeated(table)


def _with_end(batches):
    yield from (b for b in batches if b.num_rows)
    yield None


def _repeated(table: pa.Table) -> pa.RecordBatch:
    anchor = table.column("anchor").to_numpy().view(np.uint64)
    times, key, first = (table.column(c).to_numpy() for c in ("times", "key", "first"))
    hashes, owner, start = _strings(table.column("bytes").to_pylist())
    hashes = _mixed(hashes + anchor[owner])
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    hit = np.zeros(len(hashes), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    hit &= times[owner] == 1  # the others are repeated as a whole
    at = np.flatnonzero(hit)
    if not len(at):
        return _spans([], [], [])
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])]))
    ends = np.append(new[1:], len(at)) - 1
    own = owner[at[new]]
    return _spans(key[own], first[own] + start[at[new]], first[own] + start[at[ends]] + DEPTH)


def _exploded(batches):
    for batch in batches:
        if batch.num_rows:
            hashes, owner, start = _strings(batch.column(5).to_pylist())
            columns = [hashes.view(np.int64), *(batch.column(c).to_numpy()[owner] for c in (0, 2, 3)), batch.column(4).to_numpy()[owner] + start]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["string", "anchor", "times", "key", "first"])


def repeated_spans(rows: DataFrame, hot: int = HOT, cut=written) -> DataFrame:
    """``key, first, last``: spans (they may overlap) that cover just the bytes of ``rows(key, text)``
    that lie in a DEPTH-byte string which also starts elsewhere. ``cut`` writes the tables behind them."""
    spark = rows.sparkSession
    # found twice rather than stored: a second pass over the texts costs less than the table of all anchors
    occurrences = rows.select("key", "text").mapInArrow(_occurrences, "anchor long, stretch long, key long, place long")
    again = cut(occurrences.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"))
    open_ = cut(occurrences.join(again, "anchor"))
    one = F.struct("key", "place")
    distinct = cut(open_.groupBy("anchor", "stretch").agg(F.count("*").alias("times"), F.min(one).alias("one")))
    repeated = distinct.filter("times > 1").select("anchor", "stretch")
    span = [F.col("key"), F.shiftright("place", 8).alias("first"), (F.shiftright("place", 8) + F.col("place").bitwiseAND(255) + DEPTH - 1).alias("last")]
    spans = open_.join(repeated, ["anchor", "stretch"], "left_semi").select(*span)
    # anchors over which stretches differ, and some are not yet known to be repeated
    mixed = distinct.groupBy("anchor").agg(F.count("*").alias("stretches"), F.min("times").alias("least")).filter("stretches > 1 and least = 1").select("anchor", "stretches")
    wanted = distinct.join(mixed, "anchor").select("anchor", "stretch", "times", F.col("one.key").alias("key"), F.col("one.place").alias("place"), "stretches")
    by_text = wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "stretch", "times", "key", "place")).alias("wanted"))
    bytes_ = "anchor long, stretch long, times long, key long, first long, bytes binary"
    found = rows.join(by_text, "key").select("text", "wanted").mapInArrow(_stretches, bytes_)
    if not mixed.filter(F.col("stretches") > hot).isEmpty():
        very = mixed.filter(F.col("stretches") > hot).select("anchor")
        found = cut(found)
        strings = cut(found.join(very, "anchor", "left_semi").mapInArrow(_exploded, "string long, anchor long, times long, key long, first long"))
        more = strings.groupBy("string", "anchor").agg(F.count("*").alias("n")).filter("n > 1")
        spans = spans.unionByName(strings.filter("times = 1").join(more, ["string", "anchor"], "left_semi").select("key", "first", (F.col("first") + DEPTH).alias("last")))
        found = found.join(very, "anchor", "left_anti")
    compared = found.repartition(shuffle_parts(spark), "anchor").sortWithinPartitions("anchor").mapInArrow(_compared, _SPANS)
    return spans.unionByName(compared)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _cut(batches):
    for batch in sliced(batches):
        rows = []
        for text, first, last in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            runs = merged(list(zip(first or [], last or [], strict=True)))
            digest, at = hashlib.sha256(), 0
            for a, b in runs:
                digest.update(raw[at:a])
                at = b
            digest.update(raw[at:])
            rows.append((len(raw), sum(b - a for a, b in runs), len(runs), digest.hexdigest()))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _with_spans(docs: DataFrame, cut) -> DataFrame:
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = keyed(plain, "key", cut)
    spans = repeated_spans(rows, cut=cut).groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("s"))
    return rows.join(spans, "key", "left").select("doc_id", "text", F.col("s.first").alias("first"), F.col("s.last").alias("last"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs(doc_id, text)``.

    A null text is empty; texts under DEPTH bytes lose nothing. A row that repeats another one
    loses all its bytes, as any copy of at least DEPTH bytes does. Null ids stay null. An empty
    table gives an empty result. Other columns of ``docs`` are not read.
    """
    with Cuts(docs.sparkSession) as cut:
        return written(_with_spans(docs, cut).mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def _kept(batches):
    for batch in sliced(batches):
        out = []
        for text, first, last in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
            raw, parts, at = text.encode("utf-8", "surrogatepass"), [], 0
            for a, b in merged(list(zip(first or [], last or [], strict=True))):
                parts.append(raw[at:a])
                at = b
            out.append(b"".join([*parts, raw[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "kept"])


def kept_bytes(docs: DataFrame) -> DataFrame:
    """``doc_id, kept``: what is left of every text, as bytes (a cut may split a character)."""
    with Cuts(docs.sparkSession) as cut:
        return written(_with_spans(docs, cut).mapInArrow(_kept, "doc_id long, kept binary"))
