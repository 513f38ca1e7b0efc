"""The prefix trie of conversations by the Euler-tour technique.

A node is a distinct sequence of first turns. Each has an arc by which a walk round the tree
enters it and one by which it leaves; a list of arcs, each naming the next, is the tour. The
list is ranked by random mates: in every round arcs that drew heads take in a next one that
drew tails, which leaves three quarters, until a bounded rest is ranked in one task; then the
arcs taken in get their places from the one they named, round by round. Prefix sums along the
tour, taken in blocks, give every subtree's leaves and savings as the difference between its
two arcs.

Turns are placed and hashed as rows, in ranges: no conversation, node or sibling list is
gathered in one task. A prefix is known by two 64-bit sums (exclusive or) of hashes of place
and turn; a turn by the SHA-256 of its role and text, so texts are read once and not shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Cuts, shuffle_parts, written

#: Conversations of one family, whose first turns are the first one's, and turns taken from it, less one.
FAMILY, MOST = 20, 3
#: Rows of a range, siblings of a stretch, arcs of a block, and arcs that one task ranks at the end.
RANGE, SIBLINGS, BLOCK, LAST = 200_000, 50_000, 65_536, 32_768
#: Bytes of ids that are joined before they are hashed.
CHUNK = 1 << 16

SHAPE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
KEY = ["depth", "a", "b"]


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, digest, words`` of ``conversations(conv_id, turn, role, text)``."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), words.alias("words"))


def _ranges(rows: DataFrame, n: int, *order) -> DataFrame:
    parts = max(shuffle_parts(rows.sparkSession), -(-n // RANGE))
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def _numbered(batches):
    """Each row's place among those of its conversation in this range, from 1."""
    last, count = None, 0
    for batch in batches:
        ids = batch.column("conv_id").to_numpy()
        if not len(ids):
            continue
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        place = np.arange(len(ids)) - np.repeat(starts, np.diff([*starts, len(ids)])) + 1
        if ids[0] == last:
            place[: starts[1] if len(starts) > 1 else len(ids)] += count
        last, count = ids[-1], int(place[-1])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(place), batch.column("digest"), batch.column("words")], ["conv_id", "local", "digest", "words"])


def placed(rows: DataFrame, cut: Cuts) -> tuple[DataFrame, DataFrame]:
    """Turns as ``conv_id, part, local, digest, words`` and, by ``conv_id, part``, how many of the
    conversation's come in earlier parts (``before``). Equal turns are told apart by their rows."""
    known = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    ordered = _ranges(known, known.count(), F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row"))
    numbered = ordered.select("conv_id", "digest", "words").mapInArrow(_numbered, "conv_id long, local long, digest binary, words long")
    found = cut(numbered.withColumn("part", F.spark_partition_id()))
    counts = found.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    return found, cut(counts.withColumn("before", F.coalesce(before, F.lit(0))))


def _z(side: str, depth: Column, digest: Column) -> Column:
    return F.xxhash64(F.lit(side), depth.cast("long"), digest)


def _xor(cells: Column, side: str) -> Column:
    return F.aggregate(cells, F.lit(0).cast("long"), lambda x, c: x.bitwiseXOR(c[side]))


def members(conversations: DataFrame, cut: Cuts) -> DataFrame:
    """One row for each rebuilt conversation and depth: conv_id, depth, the prefix's key (a, b), its
    parent's (pa, pb), the words of the last turn, and whether the conversation ends there."""
    rows, parts = placed(turns(conversations), cut)
    at = parts.select("conv_id", "part", "before")
    lengths = parts.groupBy("conv_id").agg(F.sum("n").alias("length"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    first = rows.filter((F.col("local") <= MOST) & (F.col("conv_id") % FAMILY == 0)).join(at, ["conv_id", "part"])
    first = first.withColumn("place", F.col("before") + F.col("local")).filter(F.col("place") <= MOST)
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "digest", "words"))).alias("head"))  # MOST at most
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST + 1)
    cells = F.transform("head", lambda x, i: F.struct(x["words"].alias("words"), _z("a", i + 1, x["digest"]).alias("a"), _z("b", i + 1, x["digest"]).alias("b")))
    # a family has few conversations, so joining their first one's head repeats it as often at most
    every = lengths.withColumn("base", base).withColumn("h", taken.cast("int")).join(heads, "base", "left")
    every = every.withColumn("head", F.slice(F.coalesce(cells, F.array().cast("array<struct<words:bigint,a:bigint,b:bigint>>")), F.lit(1), F.col("h")))
    every = every.withColumn("k", F.size("head")).withColumn("all", F.col("k") + F.greatest(F.lit(0), F.col("length") - F.col("h")))
    every = cut(every.select("conv_id", "h", "k", "all", "head", _xor(F.col("head"), "a").alias("ha"), _xor(F.col("head"), "b").alias("hb")))

    ends = (F.col("depth") == F.col("all")).alias("ends")
    root = every.withColumn("depth", F.lit(0)).select("conv_id", F.col("depth").cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("a", "b")],
                                                      *[F.lit(None).cast("long").alias(c) for c in ("pa", "pb")], F.lit(0).cast("long").alias("words"), ends)
    upto = lambda side, n: _xor(F.slice("head", F.lit(1), n), side)
    shared = every.select("*", F.posexplode("head").alias("i", "x")).withColumn("depth", (F.col("i") + 1).cast("long"))
    shared = shared.select("conv_id", "depth", upto("a", F.col("i") + 1).alias("a"), upto("b", F.col("i") + 1).alias("b"), upto("a", F.col("i")).alias("pa"), upto("b", F.col("i")).alias("pb"), "x.words", ends)

    # a conversation's rows in one range are a bounded group, a conversation's ranges are few
    own = rows.join(at.join(every.drop("head"), "conv_id"), ["conv_id", "part"])
    own = own.withColumn("place", F.col("before") + F.col("local")).filter(F.col("place") > F.col("h")).withColumn("depth", F.col("k") + F.col("place") - F.col("h"))
    own = own.withColumn("za", _z("a", F.col("depth"), F.col("digest"))).withColumn("zb", _z("b", F.col("depth"), F.col("digest")))
    running = W.partitionBy("conv_id", "part").orderBy("local").rowsBetween(W.unboundedPreceding, 0)
    own = cut(own.select("conv_id", "part", "depth", "za", "zb", "ha", "hb", "words", "all", F.bit_xor("za").over(running).alias("la"), F.bit_xor("zb").over(running).alias("lb")))
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = own.groupBy("conv_id", "part").agg(F.bit_xor("za").alias("ta"), F.bit_xor("zb").alias("tb"))
    sums = sums.select("conv_id", "part", *[F.coalesce(F.bit_xor(t).over(earlier), F.lit(0)).alias(c) for t, c in (("ta", "ca"), ("tb", "cb"))])
    key = lambda s: F.col(f"h{s}").bitwiseXOR(F.col(f"c{s}")).bitwiseXOR(F.col(f"l{s}"))
    own = own.join(sums, ["conv_id", "part"]).withColumn("a", key("a")).withColumn("b", key("b"))
    own = own.select("conv_id", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("za")).alias("pa"), F.col("b").bitwiseXOR(F.col("zb")).alias("pb"), "words", ends)
    return cut(root.unionByName(shared).unionByName(own))


def nodes(of: DataFrame, cut: Cuts) -> DataFrame:
    """The nodes of ``members``: id, key, conv_id (smallest member), n_convs, words, parent's id and conv_id, n_children."""
    found = of.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), *[F.min(c).alias(c) for c in ("words", "pa", "pb")])
    found = cut(found.withColumn("id", F.monotonically_increasing_id()))
    above = found.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    linked = cut(found.join(above, ["depth", "pa", "pb"], "left").drop("pa", "pb"))
    children = linked.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    return cut(linked.join(children, "id", "left").fillna(0, ["n_children"]))


def tour(tree: DataFrame, n: int) -> DataFrame:
    """``arc, next, w``: the arcs of ``n`` nodes ``(id, parent)``, 2 id into a node and 2 id + 1 out of it.

    Siblings follow each other by a bucket of their id and the id, so that those of one parent
    are put in order bucket by bucket.
    """
    bucket = F.pmod(F.xxhash64("id"), F.lit(-(-n // SIBLINGS)))
    children = tree.filter("parent is not null").select("id", "parent", bucket.alias("bucket"))
    follows = F.lead("id").over(W.partitionBy("parent", "bucket").orderBy("id"))
    starts = children.groupBy("parent", "bucket").agg(F.min("id").alias("start"))
    after = starts.select("parent", "bucket", F.lead("start").over(W.partitionBy("parent").orderBy("bucket")).alias("after"))
    siblings = children.withColumn("follows", follows).join(after, ["parent", "bucket"]).select("id", F.coalesce("follows", "after").alias("sibling"))
    down = starts.groupBy(F.col("parent").alias("id")).agg(F.min_by("start", "bucket").alias("child"))
    all_ = tree.select("id", "parent").join(siblings, "id", "left").join(down, "id", "left")
    into = F.struct((F.col("id") * 2).alias("arc"), F.coalesce(F.col("child") * 2, F.col("id") * 2 + 1).alias("next"))
    out = F.struct((F.col("id") * 2 + 1).alias("arc"), F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("next"))
    return all_.select(F.inline(F.array(into, out))).withColumn("w", F.col("next").isNotNull().cast("long"))


def _rest_ranked(batches):
    """How far each arc of the whole rest is from the end, by pointer jumping in numpy."""
    parts = [[b.column("arc").to_numpy(), b.column("next").fill_null(-1).to_numpy(), b.column("w").to_numpy()] for b in batches if b.num_rows]
    if not parts:
        return
    arc, following, w = (np.concatenate(c) for c in zip(*parts, strict=True))
    order, end = np.argsort(arc), len(arc)
    to = np.append(np.where(following < 0, end, order[np.searchsorted(arc, following, sorter=order).clip(0, end - 1)]), end)
    d = np.append(w, 0)
    while (to != end).any():
        d, to = d + d[to], to[to]
    yield pa.RecordBatch.from_arrays([pa.array(arc), pa.array(d[:end])], ["arc", "d"])


def ranked(arcs: DataFrame, n: int, cut: Cuts) -> DataFrame:
    """``arc, d``: how many steps each of ``n`` arcs ``(arc, next, w)`` is from the end of the list."""
    state, rounds = cut(arcs), []
    while n > LAST:
        coin = lambda c, r=len(rounds): F.xxhash64(c, F.lit(r)).bitwiseAND(1)
        takes = F.col("next").isNotNull() & (coin("arc") == 0) & (coin("next") == 1)
        taking = state.filter(takes).select(F.col("next").alias("arc"), F.col("arc").alias("by"), F.col("w").alias("bw"))
        met = cut(state.withColumn("takes", takes).join(taking, "arc", "left"))
        gone = met.filter("by is not null")
        rounds.append(gone.select("arc", "next", "w"))
        n -= gone.count()
        state = cut(met.filter("by is null and not takes").select("arc", "next", "w").unionByName(gone.select(F.col("by").alias("arc"), "next", (F.col("bw") + F.col("w")).alias("w"))))
    known = cut(state.coalesce(1).mapInArrow(_rest_ranked, "arc long, d long"))  # LAST rows at most
    for gone in reversed(rounds):
        far = known.select(F.col("arc").alias("next"), F.col("d").alias("more"))
        known = cut(known.unionByName(gone.join(far, "next", "left").select("arc", (F.col("w") + F.coalesce("more", F.lit(0))).alias("d"))))
    return known


def subtrees(tree: DataFrame, distances: DataFrame, n: int, cut: Cuts) -> DataFrame:
    """``id, n_leaves, saved_tokens``: sums over the subtree of each of ``n`` nodes, from prefix sums along the tour."""
    own = tree.select("id", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    enters = F.col("arc").bitwiseAND(1) == 0
    steps = distances.select("arc", F.shiftright("arc", 1).alias("id"), (F.lit(2 * n - 1) - F.col("d")).alias("at"))
    steps = steps.join(own, "id").select("id", enters.alias("enters"), "at", *[F.when(enters, F.col(c)).otherwise(0).alias(c) for c in ("leaf", "saved")])
    steps = steps.withColumn("block", F.floor(F.col("at") / BLOCK).cast("long"))
    running = W.partitionBy("block").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    sums = cut(steps.select("id", "enters", "block", "leaf", "saved", F.sum("leaf").over(running).alias("l"), F.sum("saved").over(running).alias("s")))
    totals = sums.groupBy("block").agg(F.sum("leaf").alias("tl"), F.sum("saved").alias("ts"))  # a row for each block
    earlier = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("block", F.coalesce(F.sum("tl").over(earlier), F.lit(0)).alias("bl"), F.coalesce(F.sum("ts").over(earlier), F.lit(0)).alias("bs"))
    # before the way in, up to the way out
    signed = lambda c, own_, before: F.when(F.col("enters"), F.col(own_) - F.col(c) - F.col(before)).otherwise(F.col(c) + F.col(before))
    both = sums.join(totals, "block").groupBy("id")
    return both.agg(F.sum(signed("l", "leaf", "bl")).alias("n_leaves"), F.sum(signed("s", "saved", "bs")).alias("saved_tokens"))


def _joined(batches):
    """The ids of each node, in order, as strings of about ``CHUNK`` bytes."""
    key, ids, size, out = None, [], 0, []
    for batch in batches:
        for depth, a, b, conv in zip(*(batch.column(c).to_pylist() for c in (*KEY, "conv_id")), strict=True):
            if (depth, a, b) != key or size > CHUNK:
                if ids:
                    out.append((*key, ids[0], ",".join(map(str, ids))))
                key, ids, size = (depth, a, b), [], 0
            ids.append(conv)
            size += 8
        if len(out) > 1_000:
            yield _chunks(out)
            out = []
    if ids:
        out.append((*key, ids[0], ",".join(map(str, ids))))
    if out:
        yield _chunks(out)


def _chunks(out):
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*KEY, "first", "chunk"])


def _hashed(batches):
    """The digest of each node's strings, one after the other: a node's state is one hash, however many there are."""
    key, state, out = None, None, []
    for batch in batches:
        for depth, a, b, chunk in zip(*(batch.column(c).to_pylist() for c in (*KEY, "chunk")), strict=True):
            if (depth, a, b) != key:
                if state is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (depth, a, b), hashlib.sha256(chunk.encode())
            else:
                state.update(b"," + chunk.encode())
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*KEY, "ends_sha256"])
            out = []
    if state is not None:
        out.append((*key, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*KEY, "ends_sha256"])


def end_digests(of: DataFrame, cut: Cuts) -> DataFrame:
    """``depth, a, b, ends_sha256`` of the nodes where conversations end.

    A node's ids are joined in ranges, many to a string; the strings, some thousands of ids each,
    then pass through one hash in order, as a digest of all of them has to be taken in order.
    """
    ending = cut(of.filter("ends").select(*KEY, "conv_id"))
    ordered = _ranges(ending, ending.count(), *KEY, "conv_id")
    chunks = ordered.mapInArrow(_joined, "depth long, a long, b long, first long, chunk string")
    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_hashed, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt ``conversations(conv_id, turn, role, text)``: conv_id (its smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by ``turn``, null first, equal ones by the digest of role and text. A null
    role or text is empty. Repeated rows are turns each. Rows without ``conv_id`` belong to no
    conversation and are left out. Without conversations there is no node, not even the root.
    Other columns are not read.
    """
    spark = conversations.sparkSession
    with Cuts(spark) as cut:
        of = members(conversations, cut)
        tree = nodes(of, cut)
        n = tree.count()
        if not n:
            return spark.createDataFrame([], SHAPE)
        sums = subtrees(tree, ranked(tour(tree, n), 2 * n, cut), n, cut)
        whole = tree.join(sums, "id").join(end_digests(of, cut), KEY, "left")
        names = [c.split()[0] for c in SHAPE.split(", ")]
        return written(whole.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))).select(*names))


#: The same for small tables: CRC-32 bit by bit, prefixes as strings, subtrees by comparing prefixes.
ORACLE = r"""WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL),
crc(c, s, i, v) AS (SELECT c, s, 0, CAST(4294967295 AS BIGINT) FROM ids UNION ALL
 SELECT c, s, i + 1, xor(x >> 1, CASE WHEN x & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END) FROM (SELECT c, s, i, CASE WHEN i % 8 = 0 THEN xor(v, ascii(substr(s, i // 8 + 1, 1))) ELSE v END AS x FROM crc WHERE i < 8 * length(s))),
h AS (SELECT c, c - c % 20 AS base, xor(v, CAST(4294967295 AS BIGINT)) % 4 AS h FROM crc WHERE i = 8 * length(s)),
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d,
 len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT g.c, base, g.h, least(g.h, count(t.c)) AS k FROM h g LEFT JOIN t ON t.c = g.base GROUP BY g.c, base, g.h),
r AS (SELECT k.c, p AS depth, d, words FROM k JOIN t ON t.c = base AND p <= h UNION ALL SELECT k.c, k + p - h, d, words FROM k JOIN t ON t.c = k.c AND p > h),
m AS (SELECT c, depth, string_agg(d, '/') OVER w AS key, coalesce(string_agg(d, '/') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS up, words, depth = max(depth) OVER (PARTITION BY c) AS ends FROM r WINDOW w AS (PARTITION BY c ORDER BY depth)
 UNION ALL SELECT c, 0, '', NULL, 0, c NOT IN (SELECT c FROM r) FROM k),
n AS (SELECT key, min(depth) AS depth, min(up) AS up, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '') AS e FROM m GROUP BY key),
f AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM n x WHERE x.up = n.key) AS n_children FROM n LEFT JOIN n p ON p.key = n.up)
SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, a.parent_conv_id, a.n_convs, a.n_children, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, CAST(sum(b.saved) AS BIGINT) AS saved_tokens, sha256(a.e) AS ends_sha256
FROM f a JOIN f b ON a.key = '' OR b.key = a.key OR starts_with(b.key, a.key || '/') GROUP BY a.key, a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, a.e"""
