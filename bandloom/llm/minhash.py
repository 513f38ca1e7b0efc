"""Near-duplicate documents by MinHash.

1. Each text becomes its set of five-word shingles (64-bit hashes), 128 universal hash
   minima of the set, and 32 band keys of four minima each. At a similarity of 0.75 a pair
   misses every band once in 200,000 pairs, above it more rarely still.
2. Equal sets are one class, a node from here on.
3. Each band bucket has a centre, the member that shares most with others, and links the
   rest to it (a star, not all pairs). A node tries the two centres that it meets most.
4. Pairs pass the comparison of signatures, then that of full sets.
5. Components of the confirmed links come from alternating stars.
6. Where a bucket's members still lie in several components, its pairs across components
   are compared inside tasks, in blocks of bounded size: signatures first, each pair in the
   first bucket it shares only. The members that have a likely partner are joined with their
   full sets, and the blocks emit a spanning forest of the links found. The way is the same
   at every size of bucket, and no pair becomes a row unless it is a link that joins two
   components.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Cuts, fresh, keyed, sliced, whole_groups, written
from .components import components

WORDS = 5
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Similarity as a fraction.
NUMERATOR, DENOMINATOR = 75, 100
#: Equal minima below which a pair of similarity 0.75 falls once in a million pairs.
LEAST_EQUAL = 72
#: Centres that a node tries first; pairs of one centre that go together.
FIRST_CENTRES, TOGETHER = 2, 1_000
#: Members, and shingles of members, in a block of a bucket.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Lanes of signatures compared at once.
LANES = 1 << 22

_rng = np.random.Generator(np.random.PCG64(20_240_501))
_A = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_STEP = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, (BANDS, ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Words whose hash a worker keeps; workers live through several stages.
CACHED_WORDS = 150_000
#: Shingles that are hashed at once: a few fit the processor's caches.
_AT_ONCE = 1 << 15


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_words = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of a whole text.

    Words are runs without ASCII white space, A-Z in lower case. A text of one to four words
    has one shingle, all of it; a text without words none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    if n < WORDS:
        return _mixed(np.array([(h * _STEP[:n]).sum() + np.uint64(n)], np.uint64))
    total = h[: n - WORDS + 1] * _STEP[0]
    for k in range(1, WORDS):
        total += h[k : n - WORDS + 1 + k] * _STEP[k]
    return np.unique(_mixed(total))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(HASHES, sets) minima; the sets must not be empty."""
    out = np.empty((HASHES, len(sets)), np.uint64)
    first = 0
    while first < len(sets):
        last, size = first, 0
        while last < len(sets) and (not size or size + len(sets[last]) <= _AT_ONCE):
            size += len(sets[last])
            last += 1
        x = np.concatenate(sets[first:last])
        starts = np.cumsum([0, *(len(s) for s in sets[first : last - 1])])
        t = np.empty_like(x)
        for k in range(HASHES):
            np.multiply(x, _A[k], out=t)
            np.add(t, _B[k], out=t)
            out[k, first:last] = np.minimum.reduceat(t, starts)
        first = last
    return out


def _signed(batches):
    for batch in sliced(batches):
        sets = [shingles(t) for t in batch.column(2).to_pylist()]
        full = [i for i, s in enumerate(sets) if len(s)]
        m = minima([sets[i] for i in full]) if full else np.empty((HASHES, 0), np.uint64)
        keys = _mixed((m.reshape(BANDS, ROWS, -1) * _BAND).sum(1)).view(np.int64).T
        lanes = np.ascontiguousarray((m & np.uint64(0xFFFF)).astype(np.uint16).T)
        sizes = np.zeros(len(sets) + 1, np.int32)
        sizes[1:][full] = BANDS
        signature: list[bytes | None] = [None] * len(sets)
        for row, i in zip(lanes, full, strict=True):
            signature[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([digest_of(s) if len(s) else None for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.ascontiguousarray(keys).ravel(), pa.int64())),
                pa.array(signature, pa.binary()),
            ],
            ["row", "doc_id", "n_shingles", "digest", "bands", "signature"],
        )


def digest_of(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def _sets(batches):
    for batch in sliced(batches):
        found = [shingles(t).view(np.int64) for t in batch.column("text").to_pylist()]
        offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        items = pa.array(np.concatenate([*found, np.empty(0, np.int64)]), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(offsets, items)], ["node", "items"])


def lanes_of(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint16).reshape(-1, HASHES)


def _alike(batches):
    for batch in batches:
        a, b = (lanes_of(batch.column(k).to_pylist()) for k in ("signature_a", "signature_b"))
        keep = pa.array((a == b).sum(1) >= LEAST_EQUAL, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(keep)


def confirmed(pairs: DataFrame, reps: DataFrame, sets: DataFrame, cut: Cuts) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough.

    ``reps(node, signature)``; ``sets(node, items)``. The sets of a centre's partners go to
    the centre's set, a centre with many partners to several places.
    """
    side = lambda name: reps.select(F.col("node").alias(name), F.col("signature").alias(f"signature_{name}"))
    likely = cut(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_alike, "a long, b long"))
    many = likely.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("places"))
    place = F.pmod(F.xxhash64("b"), F.col("places")).cast("int").alias("place")
    every = F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place")
    left = many.select("a", every).join(sets, F.col("a") == F.col("node")).select("a", "place", F.col("items").alias("x"))
    right = likely.join(many, "a").select("a", "b", place).join(sets, F.col("b") == F.col("node"))
    right = right.select("a", "place", "b", F.col("items").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    found = left.join(right, ["a", "place"]).select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y") - shared).alias("all"))
    return cut(found.filter(F.col("shared") * DENOMINATOR >= F.col("all") * NUMERATOR).select("a", "b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    Null and empty texts have no shingles and are linked with nothing. Rows that repeat an id
    each get the component of their own text. A null id is linked with nothing: its component
    is null and it is not kept. Other columns of ``docs`` are not read; an empty table gives an
    empty result.
    """
    with Cuts(docs.sparkSession) as cut:
        return written(_near_duplicates(docs, cut))


def _near_duplicates(docs: DataFrame, cut: Cuts) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = keyed(texts, "row", cut).select("row", "doc_id", "text")
    shape = "row long, doc_id long, n_shingles long, digest binary, bands array<long>, signature binary"
    signed = cut(rows.mapInArrow(_signed, shape))
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    firsts = [F.first(c).alias(c) for c in ("n_shingles", "bands", "signature")]
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), *firsts)
    reps = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    members = reps.select("node", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(members.join(sizes, "bucket"))
    weights = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    heaviest = F.max_by("node", F.struct("weight", -F.col("node"))).alias("centre")
    centres = shared.join(weights, "node").groupBy("bucket").agg(heaviest)
    # a row for each node and centre, at most BANDS for a node
    tries = shared.join(centres, "bucket").filter("node <> centre").groupBy("node", "centre").agg(F.count("*").alias("times"))
    order = W.partitionBy("node").orderBy(F.desc("times"), "centre")
    first = tries.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= FIRST_CENTRES)
    pairs = cut(first.select(F.col("centre").alias("a"), F.col("node").alias("b")))
    wanted = reps.join(weights, "node", "left_semi").select("row", "node")
    sets = cut(rows.join(wanted, "row").select("node", "text").mapInArrow(_sets, "node long, items array<long>"))
    links = confirmed(pairs, reps, sets, cut)
    of = components(links)
    more = _across(shared, of, reps, sets, cut)
    if not more.isEmpty():
        of = components(links.unionByName(more))
    placed = reps.select("digest", "node", "least").join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    component = placed.join(named, "component").select("digest", "component_id")
    empty = signed.filter("digest is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    found = full.select("doc_id", "n_shingles", "digest").join(component, "digest").select("doc_id", "n_shingles", "component_id")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return found.unionByName(empty).withColumn("kept", kept)


def _across(shared: DataFrame, of: DataFrame, reps: DataFrame, sets: DataFrame, cut: Cuts) -> DataFrame:
    """Links ``(a, b)`` between nodes that share a bucket and not a component.

    The widest component of a bucket is never held against itself: its members meet the others,
    and only those meet each other, in blocks of bounded size. A member of the widest goes to as
    many blocks as the others fill, so what moves is in proportion to the others.
    """
    size = reps.select("node", "n_shingles", "bands", "signature")
    placed = shared.join(of, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    by = placed.join(size.select("node", "n_shingles"), "node").groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    total = by.groupBy("bucket").agg(F.max(F.struct("n", "component", "s")).alias("widest"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("components"))
    parts = lambda n, s: F.ceil(F.greatest(n / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    mixed = total.filter("components > 1").select(
        "bucket", F.col("widest.component").alias("widest"), parts(F.col("widest.n"), F.col("widest.s")).alias("wide"),
        parts(F.col("n") - F.col("widest.n"), F.col("s") - F.col("widest.s")).alias("others"),
    )
    left = cut(placed.join(mixed, "bucket").withColumn("inner", F.col("component") == F.col("widest")))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("inner"), F.col("wide")).otherwise(F.col("others"))).cast("int")
    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    block = lambda one, two, second, alone: F.struct(F.xxhash64("bucket", one, two).alias("block"), second.alias("second"), alone.alias("alone"))
    # parts of the widest are numbered after those of the others
    from_wide = F.transform(numbers(F.col("others")), lambda k: block(k, F.col("others") + F.col("own"), F.lit(True), F.lit(False)))
    to_wide = F.transform(numbers(F.col("wide")), lambda k: block(F.col("own"), F.col("others") + k, F.lit(False), F.lit(False)))
    among = F.transform(numbers(F.col("others")), lambda k: block(F.least(F.col("own"), k), F.greatest(F.col("own"), k), F.col("own") >= k, F.col("own") == k))
    blocks = F.when(F.col("inner"), from_wide).otherwise(F.concat(to_wide, among))
    dealt = left.withColumn("own", own).select("bucket", "node", "component", F.inline(blocks))
    likely = _by_block(dealt.join(size.drop("n_shingles"), "node")).mapInArrow(_likely, "block long, node long, component long, second boolean, alone boolean")
    return cut(_by_block(cut(likely).join(sets, "node")).mapInArrow(_linked, "a long, b long"))


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("block").sortWithinPartitions("block")


def _groups(batches):
    """Blocks of pairs: ``table, rows of the one side, rows of the other``."""
    for some in whole_groups(batches, "block"):
        block = some.column("block").to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
        for first, last in zip(edges[:-1], edges[1:], strict=True):
            group = some.slice(first, last - first)
            second = group.column("second").to_numpy()
            every = np.arange(len(group))
            alone = group.column("alone")[0].as_py()
            yield group, every if alone else every[~second], every if alone else every[second]


def _likely(batches):
    """The members of each block that have a partner of another component whose signature is like theirs."""
    for group, x, y in _groups(batches):
        of = group.column("component").to_numpy()
        if not len(x) or not len(y) or (of == of[0]).all():
            continue
        lanes = lanes_of(group.column("signature").to_pylist())
        bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        place = int(np.flatnonzero(bands[0] == group.column("bucket")[0].as_py())[0])
        hit = np.zeros(len(group), bool)
        step = max(1, LANES // (HASHES * len(y)))
        for at in range(0, len(x), step):
            own = x[at : at + step]
            like = of[own, None] != of[None, y]
            for k in range(place):  # compared in an earlier bucket
                like &= bands[own, None, k] != bands[None, y, k]
            like &= (lanes[own, None] == lanes[None, y]).sum(2) >= LEAST_EQUAL
            hit[own[like.any(1)]] = True
            hit[y[like.any(0)]] = True
        if hit.any():
            kept = group.select(["block", "node", "component", "second", "alone"]).filter(pa.array(hit))
            yield from kept.to_batches()


def _linked(batches):
    """Of the links between the components of each block: a spanning forest."""
    for group, x, y in _groups(batches):
        found = block_links(group.column("component").to_numpy(), [i.values.to_numpy() for i in group.column("items")], x, y)
        if found:
            nodes = group.column("node").to_numpy()
            a, b = (pa.array(nodes[list(side)], pa.int64()) for side in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])


def block_links(of: np.ndarray, items: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of ``x`` and ``y`` that are similar enough and join components ``of``, as long as they do."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = v = root[root[v]]
        return v

    if not len(x) or not len(y):
        return []
    sizes = np.array([len(items[i]) for i in x])
    known, where = np.unique(np.concatenate([items[i] for i in x]), return_inverse=True)
    starts = np.cumsum([0, *sizes[:-1]])
    labels, most = np.unique(of[x], return_counts=True)
    widest, found = labels[most.argmax()], []
    same = len(x) == len(y) and x[0] == y[0]
    for j in y:
        if of[j] == widest and (same or len(labels) == 1):
            continue  # its partners in other components look for it
        at = np.minimum(np.searchsorted(known, items[j]), len(known) - 1)
        mark = np.zeros(len(known), np.int32)
        mark[at[known[at] == items[j]]] = 1
        shared = np.add.reduceat(mark[where], starts)
        near = shared * DENOMINATOR >= (sizes + len(items[j]) - shared) * NUMERATOR
        for i in x[near & (of[x] != of[j])].tolist():
            a, b = find(int(of[i])), find(int(of[j]))
            if a != b:
                root[a] = b
                found.append((int(j), i))
    return found


def remove_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns kept, without near duplicates: of each group the row of
    the smallest id stays, or any one where ids repeat or are all null.

    Rows are told apart whatever their ids. Null and empty texts are no duplicates of anything.
    """
    key = fresh(docs, "row_key")
    rows = keyed(docs, key)
    groups = near_duplicates(rows.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias("k"), "component_id")
    ids = rows.select(F.col(key).alias("k"), F.col("doc_id").cast("long").alias("id"))
    first = F.min_by("k", F.struct(F.col("id").isNull(), "id", "k")).alias(key)
    stay = groups.join(ids, "k").groupBy("component_id").agg(first).select(key)
    return rows.join(stay, key, "left_semi").select(*docs.columns)
