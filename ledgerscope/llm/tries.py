"""Prefix trie of conversations by the Euler-tour technique.

Every conversation is a path from the root; conversations that begin with the
same turns share the nodes of these turns.  Subtree figures need no walk over
the tree:

1. Nodes.  A turn is a digest; a prefix is the sum of hashes of its
   (position, turn) pairs, two words of 64 bits, so prefixes of all lengths
   come from running sums (``ordered.running``), however long a conversation.
2. Tour.  Each node has an enter and an exit arc.  Siblings lie next to each
   other in one range-partitioned sort, and each row of it, with the row
   before, gives the tour's links: parent's enter to first child's enter, exit
   to next sibling's enter, last child's exit to parent's exit, and a leaf's
   enter to its exit.
3. List ranking.  Arcs are range partitioned by their node's least
   conversation and depth, which keeps most links inside a partition.  Every
   partition contracts its chains to one segment each (pointer doubling on
   arrays); the segments are ranked by distributed pointer jumping, in as many
   rounds as their count has bits.
4. Sums.  Each arc gets the sum of weights from itself to the tour's end.  A
   subtree's leaves and savings are the difference between the sums at its
   enter and at its exit arc.

Defined cases: null role or text is empty; rows without a conversation id
take no part; turns are ordered by turn number (null first), ties by a digest
of role and text, and repeated rows are turns of their own.  An empty table
has no conversation and gives no node, not even a root.  Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.hashing import materialise
from ledgerscope.llm.ordered import running, sorted_parts

CHUNK = 1 << 16  # characters of joined ids in one row
KEY = ["depth", "p1", "p2"]


# --------------------------------------------------------------------------
# turns and shared prefixes


def turns(conversations: DataFrame) -> DataFrame:
    """``conv, i, digest, size``: the turns of each conversation, numbered from 1."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)).alias("digest"),
        F.char_length(text).cast("long").alias("size"),
        F.lit(1).cast("long").alias("one"),
    )
    counted = running(rows, "conv", ["turn", "digest"], ["one"], "turns")
    return counted.select("conv", F.col("upto_one").alias("i"), "digest", "size")


def graft(own: DataFrame, base_of: Column, first: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that start with turns of another one.

    ``base_of`` is the id of a conversation's base and ``first`` (at most
    ``most``), both expressions over ``conv``: the conversation becomes the
    base's first turns, as many as ``first`` says, then its own turns after
    that many.  An absent base has no turns.

    Returns the turns ``conv, i, digest, size`` and the conversations
    ``conv, n`` with their new number of turns.
    """
    counts = materialise(own.groupBy("conv").agg(F.max("i").alias("n")), "conversations")
    heads = own.where(F.col("i") <= most)
    bases = counts.select(F.col("conv").alias("base"), F.least("n", F.lit(most)).alias("there"))
    wanted = counts.select("conv", "n", base_of.alias("base"), first.cast("long").alias("first"))
    sized = wanted.join(bases, "base", "left").select(
        "conv", "base", "n", "first", F.least("first", F.coalesce("there", F.lit(0))).alias("taken")
    )
    sized = materialise(sized, "grafts")
    copies = sized.where("taken > 0").join(heads.withColumnRenamed("conv", "base"), "base").where("i <= taken").select("conv", "i", "digest", "size")
    short = sized.where("taken < first").select("conv", "taken")
    rest = own.where(F.col("i") > first).join(short, "conv", "left")
    rest = rest.select("conv", (F.col("i") - F.when(F.col("taken").isNull(), 0).otherwise(first - F.col("taken"))).alias("i"), "digest", "size")
    return copies.union(rest), sized.select("conv", (F.col("taken") + F.greatest(F.col("n") - F.col("first"), F.lit(0))).alias("n"))


# --------------------------------------------------------------------------
# nodes


def prefixes(own: DataFrame) -> DataFrame:
    """Each turn with the key of the prefix it ends (``depth, p1, p2``) and of the prefix before it (``q1, q2``)."""
    hashed = own.select("conv", "i", "size", F.xxhash64("digest", "i").alias("t1"), F.xxhash64(F.lit(7), "i", "digest").alias("t2"))
    return running(hashed, "conv", ["i"], ["t1", "t2"], "prefixes").select(
        "conv", "size", F.col("i").alias("depth"), F.col("upto_t1").alias("p1"), F.col("upto_t2").alias("p2"), F.col("before_t1").alias("q1"), F.col("before_t2").alias("q2")
    )


def nodes(prefix: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node, linked to its parent: ``node`` (a number), key, ``conv``, ``n_convs``, ``saved``, ``n_children``, parent columns."""
    zero = F.lit(0).cast("long")
    inner = prefix.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv"), F.min("size").alias("size"), F.min("q1").alias("q1"), F.min("q2").alias("q2"))
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "n_convs", "conv", zero.alias("size"), F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"))
    every = inner.unionByName(root).withColumn("saved", (F.col("n_convs") - 1) * F.col("size")).withColumn("node", F.monotonically_increasing_id())
    every = materialise(every, "nodes")
    kids = every.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    every = materialise(every.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    up = every.select(
        (F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"),
        F.col("node").alias("parent"), F.col("conv").alias("parent_conv"), F.col("saved").alias("parent_saved"),
    )
    return materialise(every.join(up, ["depth", "q1", "q2"], "left").drop("q1", "q2", "size"), "nodes")


# --------------------------------------------------------------------------
# the tour

LINKS = "arc long, next long, leaves long, saved long, place long, spot long"
SEEN = ["node", "parent", "conv", "depth", "parent_conv", "parent_saved", "saved", "n_children"]


def _between(prev: dict[str, np.ndarray], this: dict[str, np.ndarray]) -> list[tuple]:
    """Links given by rows and the rows before them: arcs, next arcs, savings, places, depths."""
    same = prev["parent"] == this["parent"]
    new = ~same
    zero = np.zeros(len(same), np.int64)
    return [
        (2 * prev["node"][same] + 1, 2 * this["node"][same], zero[same], prev["conv"][same], prev["depth"][same]),
        (2 * prev["node"][new] + 1, 2 * prev["parent"][new] + 1, zero[new], prev["conv"][new], prev["depth"][new]),
        _first(this, new),
    ]


def _first(this: dict[str, np.ndarray], of: np.ndarray) -> tuple:
    return (2 * this["parent"][of], 2 * this["node"][of], this["parent_saved"][of], this["parent_conv"][of], this["depth"][of] - 1)


def tour(tree: DataFrame) -> DataFrame:
    """The Euler tour as links ``arc, next`` with weights; arc ``2 * node`` enters and ``2 * node + 1`` leaves.

    Entering a node weighs its savings and, at a leaf, one leaf; ``next`` is
    null at the end.  ``place`` and ``spot`` are the node's least conversation and depth.
    """
    spark = tree.sparkSession
    schema = LINKS + ", part int, side int, " + ", ".join(f"of_{c} long" for c in SEEN)

    def emit(arc, to, leaves, saved, place, spot) -> pa.RecordBatch:
        none = pa.nulls(len(arc), pa.int64())
        columns = [pa.array(x) for x in (arc, to, leaves, saved, place, spot)]
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(arc), pa.int32()), pa.nulls(len(arc), pa.int32()), *[none] * len(SEEN)], names=names)

    names = [f.split()[0] for f in schema.split(", ")]

    def edge(part: int, side: int, row: dict[str, np.ndarray]) -> pa.RecordBatch:
        none = pa.nulls(1, pa.int64())
        return pa.RecordBatch.from_arrays([*[none] * 6, pa.array([part], pa.int32()), pa.array([side], pa.int32()), *(pa.array(row[c]) for c in SEEN)], names=names)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before: dict[str, np.ndarray] | None = None
        for b in batches:
            if b.num_rows == 0:
                continue
            this = {c: b.column(k).to_numpy() for k, c in enumerate(SEEN)}
            if before is None:
                yield edge(part, 0, {c: v[:1] for c, v in this.items()})
                prev, rows = {c: v[:-1] for c, v in this.items()}, {c: v[1:] for c, v in this.items()}
            else:
                prev, rows = {c: np.concatenate([before[c], v[:-1]]) for c, v in this.items()}, this
            for arc, to, saved, place, spot in _between(prev, rows):
                yield emit(arc, to, np.zeros(len(arc), np.int64), saved, place, spot)
            leaf = this["n_children"] == 0
            node = this["node"][leaf]
            yield emit(2 * node, 2 * node + 1, np.ones(len(node), np.int64), this["saved"][leaf], this["conv"][leaf], this["depth"][leaf])
            before = {c: v[-1:].copy() for c, v in this.items()}
        if before is not None:
            yield edge(part, 1, before)

    # Siblings lie together; their order is free, least conversation first keeps it local.
    siblings = sorted_parts(tree.where("depth > 0").select(*SEEN), ["parent_conv", "depth", "parent", "conv", "node"])
    found = materialise(siblings.mapInArrow(local, schema), "tour")

    # Between partitions: their first and last rows, two a partition.
    links, last = [], None
    for r in found.where("side IS NOT NULL").orderBy("part", "side").collect():
        row = {c: np.array([r[f"of_{c}"]], np.int64) for c in SEEN}
        if r["side"] == 1:
            last = row
        elif last is None:
            links.append(_first(row, np.array([True])))
        else:
            links.extend(_between(last, row))
    if last is not None:
        links.append((2 * last["node"] + 1, 2 * last["parent"] + 1, np.zeros(1, np.int64), last["conv"], last["depth"]))
    rows = [(int(a), int(t), 0, int(s), int(p), int(d)) for link in links for a, t, s, p, d in zip(*link, strict=True)]
    root = tree.where("depth = 0")
    zero = F.lit(0).cast("long")
    end = root.select((2 * F.col("node") + 1).alias("arc"), F.lit(None).cast("long").alias("next"), zero.alias("leaves"), zero.alias("saved"), F.col("conv").alias("place"), zero.alias("spot"))
    alone = root.where("n_children = 0").select((2 * F.col("node")).alias("arc"), (2 * F.col("node") + 1).alias("next"), F.lit(1).cast("long").alias("leaves"), "saved", F.col("conv").alias("place"), zero.alias("spot"))
    return found.where("side IS NULL").select(*end.columns).union(spark.createDataFrame(rows, LINKS)).union(end).union(alone)


# --------------------------------------------------------------------------
# list ranking

SEGMENTS = "arc long, out long, leaves long, saved long, head boolean"


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of one partition: per arc the sums to its chain's end and the arc that follows there (``out``)."""
    table = pa.Table.from_batches(list(batches))
    if not table.num_rows:
        return
    table = table.combine_chunks()
    arc = table.column("arc").to_numpy()
    order = np.argsort(arc)
    arc = arc[order]
    nxt = table.column("next").fill_null(-1).to_numpy()[order]
    sums = np.stack([table.column(c).to_numpy()[order] for c in ("leaves", "saved")])
    n = len(arc)
    at = np.minimum(np.searchsorted(arc, nxt), n - 1)
    ptr = np.append(np.where(arc[at] == nxt, at, n), n)  # n: the next arc is elsewhere
    head = np.ones(n + 1, bool)
    head[ptr] = False
    sums = np.concatenate([sums, np.zeros((2, 1), np.int64)], axis=1)
    end = np.arange(n + 1)
    while (ptr[:n] < n).any():
        sums = sums + sums[:, ptr]
        end = np.where(ptr < n, end[ptr], end)
        ptr = ptr[ptr]
    out = nxt[end[:n]]
    for a in range(0, n, 1 << 16):
        s = slice(a, min(n, a + (1 << 16)))
        columns = [pa.array(arc[s]), pa.array(out[s], mask=out[s] < 0), pa.array(sums[0, s]), pa.array(sums[1, s]), pa.array(head[s])]
        yield pa.RecordBatch.from_arrays(columns, names=["arc", "out", "leaves", "saved", "head"])


def rank(links: DataFrame) -> DataFrame:
    """``arc, leaves, saved``: the sums of weights from each arc to the end of the list."""
    segments = materialise(sorted_parts(links, ["place", "spot", "arc"]).mapInArrow(_contract, SEGMENTS), "segments")
    ahead = segments.where("head").select("arc", "out", "leaves", "saved")
    while ahead.where("out IS NOT NULL").limit(1).count():
        y = ahead.select(F.col("arc").alias("y"), F.col("out").alias("y_out"), F.col("leaves").alias("y_leaves"), F.col("saved").alias("y_saved"))
        plus = [(F.col(c) + F.coalesce(f"y_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
        ahead = materialise(ahead.join(y, F.col("out") == F.col("y"), "left").select("arc", F.col("y_out").alias("out"), *plus), "ranks")
    y = ahead.select(F.col("arc").alias("y"), F.col("leaves").alias("y_leaves"), F.col("saved").alias("y_saved"))
    plus = [(F.col(c) + F.coalesce(f"y_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
    return segments.join(y, F.col("out") == F.col("y"), "left").select("arc", *plus)


def subtrees(tree: DataFrame) -> DataFrame:
    """``node, n_leaves, saved_tokens`` of each node's subtree, its top included."""
    enters = F.col("arc") % 2 == 0
    sums = [F.sum(F.when(enters, F.col(c)).otherwise(-F.col(c))).alias(name) for c, name in (("leaves", "n_leaves"), ("saved", "saved_tokens"))]
    return rank(tour(tree)).groupBy(F.shiftright("arc", 1).alias("node")).agg(*sums)


# --------------------------------------------------------------------------
# ends


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one node's ids, joined to rows of bounded length."""
    key, ids, size = None, [], 0

    def row() -> pa.RecordBatch:
        values = [*key, ids[0]]
        return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in values), pa.array([",".join(map(str, ids))])], names=[*KEY, "least", "joined"])

    for b in batches:
        for *k, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if k != key or size > CHUNK:
                if ids:
                    yield row()
                key, ids, size = k, [], 0
            ids.append(conv)
            size += len(str(conv)) + 1
    if ids:
        yield row()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's joined ids, as its rows pass in order."""
    key, sha = None, None
    done: list[tuple] = []

    def rows() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3])], names=[*KEY, "ends_sha256"])

    for b in batches:
        for *k, _, joined in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if k != key:
                if key is not None:
                    done.append((*key, sha.hexdigest()))
                key, sha = k, hashlib.sha256(joined.encode())
            else:
                sha.update(b"," + joined.encode())
            if len(done) >= 4096:
                yield rows()
                done.clear()
    if key is not None:
        done.append((*key, sha.hexdigest()))
        yield rows()


def ends(prefix: DataFrame, convs: DataFrame) -> DataFrame:
    """Node key and ``ends_sha256`` of the nodes where conversations end."""
    zero = F.lit(0).cast("long")
    last = prefix.groupBy("conv").agg(F.max(F.struct(*KEY)).alias("k")).select(*(F.col(f"k.{c}").alias(c) for c in KEY), "conv")
    last = last.union(convs.where("n = 0").select(zero, zero, zero, "conv"))
    spec = "depth long, p1 long, p2 long"
    chunks = sorted_parts(last, [*KEY, "conv"]).mapInArrow(_chunks, f"{spec}, least long, joined string")
    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "least").mapInArrow(_digests, f"{spec}, ends_sha256 string")


def trie(own: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie of conversations with turns ``own (conv, i, digest, size)``; ``convs (conv, n)`` also names turnless ones.

    One row per node: ``conv_id`` (least member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.
    """
    prefix = prefixes(own)
    tree = nodes(prefix, convs)
    out = tree.join(subtrees(tree), "node").join(ends(prefix, convs), KEY, "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, base_every: int = 100, most_shared: int = 5) -> DataFrame:
    """Trie of the conversations after each got the first turns of its group's base (see ``graft``).

    The base of conversation c is ``c - c % base_every`` and it lends
    ``crc32(decimal c) % (most_shared + 1)`` turns.
    """
    conv = F.col("conv")
    first = F.crc32(conv.cast("string").cast("binary")) % (most_shared + 1)
    own, convs = graft(turns(conversations), conv - conv % base_every, first, most_shared)
    return trie(own, convs)
