"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct five-word shingles.  Two documents link
when the sets' Jaccard similarity is at least 3/4, which for sizes a <= b
means b <= 4a/3 and a symmetric difference of at most (a + b) / 7.

Sketches.  Sizes are grouped in bands of powers of two.  The scheme of a band
deals the shingle hashes into ``parts`` words of 64 bits and xors each hash
into its word; a shingle that only one of two documents has changes one word
at most, so the number of unequal words is a lower bound of the symmetric
difference d: at least ``parts - d`` words agree.

Pigeonhole.  With all documents' words in one common order, two documents
that agree in all but d words share one of their first d + 1.  The order is
ordinary words, words made of frequent shingles only, empty words; so a
passage that many documents share rarely becomes a join key.  A document
enters the scheme of its own band (as the smaller or the larger one), and that of the
band below if it can be the larger one there.  Frequent shingles come from a
bounded hash sample of documents; they decide the order, never the result.

Join.  Words are dealt by key to tasks.  A group of at most ``small_group``
documents gives all its pairs; of a larger one every member is paired with
the least, and the group is kept aside.  Candidates whose parity bit sketches
(of about two bits a shingle) are too far apart are left out, as the Hamming
distance is a lower bound too; the others are verified on the texts.  Aside groups whose members then are in more
than one component are compared further: members outside the group's largest
component against all members of other components, as blocks of sketches
inside tasks that put out only the pairs close enough.  First each outsider's closest
members in every other component of its largest group are verified, which joins most components
at once, then the close pairs of all groups between components that are still apart.  No link is lost and
no cap applies.  Equal sets inside a map task are collapsed before anything is shuffled.

Defined cases: null or empty texts and texts without words have no shingle
and link with nothing; a shorter text is one shingle; equal texts link;
rows that repeat a document id are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import _pieces, hash_sample, id_and_text, map_batches, tidy
from ledgerscope.llm.components import components
from ledgerscope.llm.hashing import U, materialise, mix, shingle_hashes, slices, word_hashes

SLICE = 1_000_000  # bytes of text handled at once
PARTS_PER_SHINGLE = 0.6
LEAST_PARTS = 16
LEAST_BITS = 1024  # of a bit sketch
BLOCK = 1024  # members of a group in one block of sketches
CLOSEST = 2  # members of a component that are verified first
SEEN = 50_000  # sets that a map task remembers to collapse equal ones
MAX_IDS = 1_000_000  # candidate documents whose ids are broadcast (8 MB); more are joined by shuffle


def linked(inter: int, a: int, b: int) -> bool:
    return 100 * inter >= 75 * (a + b - inter) and inter > 0


def sets_of(texts: list[bytes]) -> Iterator[np.ndarray]:
    for a, b in slices(texts, SLICE):
        for words in word_hashes(texts[a:b]):
            yield shingle_hashes(words)


def schemes(n: int) -> list[tuple[int, int, int]]:
    """(band, parts, how many words to keep) of each scheme that a set of size ``n`` enters."""
    band = n.bit_length() - 1
    out = []
    for k in range(band, max(band - 2, -1), -1):  # its own band, the band below
        top = (2 << k) - 1  # largest size of the band
        as_smaller = (n + 4 * n // 3) // 7 if k == band else 0
        as_larger = (n + min(n, top)) // 7
        if k == band or 3 * n <= 4 * top:
            parts = max(LEAST_PARTS, int(PARTS_PER_SHINGLE * top) + 1)
            out.append((k, parts, max(as_smaller, as_larger) + 1))
    return out


def keys_of(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Join keys of one set: the first words of each scheme in the common order."""
    keys = []
    spread = mix(shingles ^ U(0xA5A5A5A5A5A5A5A5))
    ordinary = ~_contains(frequent, shingles)
    for band, parts, keep in schemes(len(shingles)):
        part = ((shingles >> U(32)) * U(parts) >> U(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        at = np.flatnonzero(np.diff(part[order], prepend=-1))
        words = np.bitwise_xor.reduceat(spread[order], at)
        plain = np.logical_or.reduceat(ordinary[order], at)
        full = part[order][at]
        scheme = mix(np.array([band], U))
        key = mix(words ^ mix(full.astype(U) + scheme))
        if len(key) < keep:
            empty = np.setdiff1d(np.arange(parts), full, assume_unique=True)
            key = np.concatenate([key, mix(mix(empty.astype(U) + scheme) ^ U(1))])
            kind = np.concatenate([np.where(plain, 0, 1), np.full(len(empty), 2)])
        else:
            kind = np.where(plain, 0, 1)
        if len(key) > keep:
            key = key[np.lexsort((key, kind))[:keep]]
        keys.append(key)
    return np.concatenate(keys)


def _contains(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values a sorted table holds."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    return table[np.minimum(at, len(table) - 1)] == values


def frequent_shingles(texts: DataFrame, sample_docs: int = 4000, least_docs: int = 4, table_size: int = 200_000) -> np.ndarray:
    """Sorted hashes of shingles that several documents of a bounded sample have; at most ``table_size``."""

    def count(cols):
        hashes = [s for s in sets_of(cols["text"]) if len(s)]
        if not hashes:
            return None
        h, n = np.unique(np.concatenate(hashes), return_counts=True)
        return {"h": h.view(np.int64), "n": n}

    sample = hash_sample(texts, "doc_id", sample_docs, salt=6)
    counts = map_batches(sample.select("text"), count, "h long, n long", binary=("text",)).groupBy("h").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= least_docs).orderBy(F.desc("n"), "h").limit(table_size).collect()
    return np.sort(np.array([r["h"] for r in rows], np.int64).view(U))


KEYED = "bucket int, keys binary, ids binary, sizes binary"
PAIRS = "kind int, a long, b long"  # kind 0: candidate pair, 1: member b of the large group a, 2: equal sets


def _keyed(texts: DataFrame, frequent, buckets: int) -> DataFrame:
    """Join keys of all documents, packed by bucket (bucket -1: pairs of equal sets)."""

    def run(batches):
        seen: dict[bytes, int] = {}
        for b in _pieces(batches):
            ids, data = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()
            for x, y in slices(data, SLICE):
                keys, of, sizes, equal = [], [], [], []
                for doc, words in zip(ids[x:y], word_hashes(data[x:y]), strict=True):
                    s = shingle_hashes(words)
                    if doc is None or not len(s):
                        continue
                    same = seen.setdefault(len(s).to_bytes(8, "little") + s[:1].tobytes() + np.bitwise_xor.reduce(mix(s)).tobytes() + s.sum(dtype=U).tobytes(), doc)
                    if same != doc:
                        equal.append((doc, same))
                        continue
                    k = keys_of(s, frequent.value)
                    keys.append(k)
                    of.append(np.full(len(k), doc, np.int64))
                    sizes.append(np.full(len(k), len(s), np.int32))
                rows = []
                if keys:
                    k, d, n = np.concatenate(keys), np.concatenate(of), np.concatenate(sizes)
                    bucket = (k >> U(33)).astype(np.int64) % buckets
                    order = np.argsort(bucket, kind="stable")
                    k, d, n, bucket = k[order], d[order], n[order], bucket[order]
                    at = np.flatnonzero(np.diff(bucket, prepend=-1))
                    rows = [(int(bucket[i]), k[i:j].tobytes(), d[i:j].tobytes(), n[i:j].tobytes()) for i, j in zip(at, [*at[1:], len(k)], strict=True)]
                if equal:
                    rows.append((-1, np.array([p for p, _ in equal], np.int64).tobytes(), np.array([q for _, q in equal], np.int64).tobytes(), b""))
                if rows:
                    cols = zip(*rows, strict=True)
                    types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["bucket", "keys", "ids", "sizes"])
            if len(seen) > SEEN:
                seen.clear()
        pa.default_memory_pool().release_unused()

    return texts.mapInArrow(tidy(run), KEYED)


def _group_pairs(keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, small_group: int, seen: set[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (a < b) and rows (group, member) of the large groups; ``seen`` holds the names of groups given before."""
    order = np.lexsort((ids, keys))
    keys, ids, sizes = keys[order], ids[order], sizes[order].astype(np.int64)
    fresh = np.ones(len(keys), bool)  # a document may hold a key twice
    fresh[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    keys, ids, sizes = keys[fresh], ids[fresh], sizes[fresh]
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    length = np.diff(np.concatenate((start, [len(keys)])))
    pairs, members = [], []
    group = np.repeat(np.arange(len(start)), length)
    place = np.arange(len(keys)) - np.repeat(start, length)
    size_of = np.repeat(length, length)
    for step in range(1, small_group):  # all pairs of the small groups, one distance at a time
        left = np.flatnonzero((size_of <= small_group) & (place + step < size_of))
        if not len(left):
            break
        pairs.append((left, left + step))
    star = np.flatnonzero((size_of > small_group) & (place > 0))
    pairs.append((start[group[star]], star))
    left, right = (np.concatenate(x) for x in zip(*pairs, strict=True))
    small, large = np.minimum(sizes[left], sizes[right]), np.maximum(sizes[left], sizes[right])
    ok = 3 * large <= 4 * small
    found = np.unique(np.column_stack([ids[left[ok]], ids[right[ok]]]), axis=0) if ok.any() else np.zeros((0, 2), np.int64)
    for g in np.flatnonzero(length > small_group):
        own = ids[start[g] : start[g] + length[g]]
        digest = mix(own.astype(U)).sum(dtype=U)
        if (name := digest.tobytes()) not in seen:  # many keys have the same members
            seen.add(name)
            members.append(np.column_stack([np.full(len(own), digest.view(np.int64)), own]))
    return found, np.concatenate(members) if members else np.zeros((0, 2), np.int64)


def candidates(texts: DataFrame, small_group: int = 12, sample_docs: int = 4000) -> DataFrame:
    """Rows ``kind, a, b``: candidate pairs, members of large groups, pairs of equal sets."""
    spark = texts.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_shingles(texts, sample_docs))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 8 * parts

    def run(batches):
        seen: set[bytes] = set()
        packed: list[tuple[bytes, bytes, bytes]] = []

        def found() -> Iterator[pa.RecordBatch]:
            columns = [np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*packed, strict=True), (U, np.int64, np.int32), strict=True)]
            packed.clear()
            for kind, rows in enumerate(_group_pairs(*columns, small_group, seen)):
                for at in range(0, len(rows), 1 << 16):
                    yield _rows(kind, rows[at : at + (1 << 16)])

        last = None
        for b in batches:  # sorted by bucket: one of them is held at a time
            for i in range(b.num_rows):
                bucket, k, d, n = (b.column(c)[i].as_py() for c in range(4))
                if bucket == -1:
                    x, y = np.frombuffer(k, np.int64), np.frombuffer(d, np.int64)
                    yield _rows(2, np.column_stack([np.minimum(x, y), np.maximum(x, y)]))
                    continue
                if bucket != last and packed:
                    yield from found()
                last = bucket
                packed.append((k, d, n))
        if packed:
            yield from found()
        pa.default_memory_pool().release_unused()

    # Rows of equal sets (bucket -1) are spread by their own hash.
    keyed = _keyed(texts, frequent, buckets)
    spread = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.pmod(F.xxhash64("keys"), F.lit(buckets)))
    return keyed.repartition(parts, spread).sortWithinPartitions("bucket").mapInArrow(tidy(run), PAIRS)


def _rows(kind: int, pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(pairs), kind, np.int32)), pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["kind", "a", "b"]
    )


def _only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts`` with one of the ids (one column)."""
    ids = ids.toDF("doc_id").distinct()
    small = ids.count() <= MAX_IDS
    return texts.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")


def sketch_of(shingles: np.ndarray) -> bytes:
    """Parity sketch: each shingle flips one of 2**k bits, at least ``LEAST_BITS`` and twice as many as shingles.

    Xoring both halves of a sketch gives the sketch of half the size.
    """
    bits = max(LEAST_BITS, 1 << (2 * len(shingles) - 1).bit_length())
    flips = np.bincount((mix(shingles) >> U(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def sketches(texts: DataFrame) -> DataFrame:
    """``doc``, its set's size ``n``, and its parity bit sketch ``sk``.

    The Hamming distance of two sketches, the longer one folded to the size of
    the other, is at most the symmetric difference of the sets.
    """

    def batch(cols):
        found = [(len(s), sketch_of(s)) for s in sets_of(cols["text"])]
        return {"doc": cols["doc_id"], "n": [n for n, _ in found], "sk": [x for _, x in found]}

    return map_batches(texts, batch, "doc long, n long, sk binary", binary=("text",)).dropDuplicates(["doc"])


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) folded to ``width`` words."""
    while words.shape[1] > width:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def stacked(sketch: list[bytes]) -> np.ndarray:
    """Sketches of one size as rows of 64-bit words."""
    return np.frombuffer(b"".join(sketch), U).reshape(len(sketch), -1)


def near(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sizes and sketches allow a link: at most a seventh of both sets differs."""
    x, y = sketch.alias("x"), sketch.alias("y")
    sizes = (3 * F.greatest("x.n", "y.n") <= 4 * F.least("x.n", "y.n"))
    first = pairs.join(x, F.col("a") == F.col("x.doc"))
    both = first.join(y, (F.col("b") == F.col("y.doc")) & sizes).select("a", "b", (F.col("x.n") + F.col("y.n")).alias("n"), F.col("x.sk").alias("x"), F.col("y.sk").alias("y"))

    def batch(cols):
        n, widths = np.array(cols["n"], np.int64), np.array([(len(x), len(y)) for x, y in zip(cols["x"], cols["y"], strict=True)]).reshape(-1, 2)
        keep = np.zeros(len(n), bool)
        for wx, wy in np.unique(widths, axis=0):
            at = np.flatnonzero((widths == (wx, wy)).all(1))
            least = min(wx, wy) // 8
            one, other = (folded(stacked([cols[c][i] for i in at]), least) for c in ("x", "y"))
            keep[at] = 7 * np.bitwise_count(one ^ other).sum(1, dtype=np.int64) <= n[at]
        return {c: np.array(cols[c], np.int64)[keep] for c in ("a", "b")}

    return map_batches(both, batch, "a long, b long")


def similarity(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, na, nb, inter`` of each pair of document ids, from the texts of these documents only."""
    wanted = _only(texts, pairs.select("a").union(pairs.select("b"))).groupBy("doc_id").agg(F.min("text").alias("text"))
    left = wanted.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = wanted.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def batch(cols):
        known: dict[int, np.ndarray] = {}

        def own(doc: int, text: bytes) -> np.ndarray:
            if doc not in known:
                if len(known) > 64:
                    known.clear()
                known[doc] = next(sets_of([text]))
            return known[doc]

        out: dict[str, list] = {"a": cols["a"], "b": cols["b"], "na": [], "nb": [], "inter": []}
        for a, b, x, y in zip(cols["a"], cols["b"], cols["text_a"], cols["text_b"], strict=True):
            s, t = own(a, x), own(b, y)
            out["na"].append(len(s))
            out["nb"].append(len(t))
            out["inter"].append(int(_contains(t, s).sum()))
        return out

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return map_batches(joined, batch, "a long, b long, na long, nb long, inter long", binary=("text_a", "text_b"))


UNIT = ["grp", "j", "k"]


def _close(unit: dict[str, np.ndarray], sketch: list[bytes], best_only: bool) -> np.ndarray:
    """Pairs (a < b) of one unit that sketches and sizes allow: asking rows against the block's rows of other components."""
    role, n, comp, doc = unit["role"], unit["n"], unit["comp"], unit["doc"]
    width = np.array([len(s) for s in sketch])
    words = {int(w): stacked([sketch[i] for i in np.flatnonzero(width == w)]) for w in np.unique(width)}
    place = np.zeros(len(n), np.int64)  # of a row among those of its width
    for w in words:
        place[width == w] = np.arange((width == w).sum())
    found = [np.zeros((0, 4), np.int64)]  # asking row, its pair's row, distance
    for wq in words:
        for wb in words:
            if not wq <= 2 * wb <= 4 * wq:  # sizes within 4/3 have sketches within a factor of 2
                continue
            asking, block = np.flatnonzero((role == 1) & (width == wq)), np.flatnonzero((role == 0) & (width == wb))
            least = min(wq, wb) // 8
            listed = folded(words[wb][place[block]], least)
            for at in range(0, len(asking) if len(block) else 0, 128):
                q = asking[at : at + 128]
                ask = folded(words[wq][place[q]], least)
                x, y = n[q, None], n[block]
                ok = (comp[q, None] != comp[block]) & (3 * np.maximum(x, y) <= 4 * np.minimum(x, y))
                i, k = np.nonzero(ok)
                for s in range(0, len(i), 1 + (1 << 19) // least):
                    e = slice(s, s + 1 + (1 << 19) // least)
                    far = np.bitwise_count(ask[i[e]] ^ listed[k[e]]).sum(1, dtype=np.int64)
                    near_ = 7 * far <= n[q[i[e]]] + n[block[k[e]]]
                    found.append(np.column_stack([q[i[e]], block[k[e]], far, far])[near_])
    hits = np.concatenate(found)
    if best_only and len(hits):
        q, other = hits[:, 0], comp[hits[:, 1]]
        order = np.lexsort((doc[hits[:, 1]], hits[:, 2], other, q))
        hits, q, other = hits[order], q[order], other[order]
        start = np.flatnonzero(np.concatenate(([True], (q[1:] != q[:-1]) | (other[1:] != other[:-1]))))
        rank = np.arange(len(hits)) - np.repeat(start, np.diff(np.append(start, len(hits))))
        hits = hits[rank < CLOSEST]
    a, b = doc[hits[:, 0]], doc[hits[:, 1]]
    return np.column_stack([np.minimum(a, b), np.maximum(a, b)])


def outsider_pairs(members: DataFrame, nodes: DataFrame, sketch: DataFrame, best_only: bool) -> DataFrame:
    """Candidate pairs ``a, b`` between components inside the groups ``members (grp, doc)``.

    With ``best_only`` an outsider asks in the largest of its groups only.
    """
    placed = members.join(nodes, members["doc"] == nodes["node"], "left").select("grp", "doc", F.coalesce("component", "doc").alias("comp"))
    parts = placed.groupBy("grp", "comp").agg(F.count("*").alias("n"))
    main = parts.groupBy("grp").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("total"), F.count("*").alias("comps")).where("comps > 1")
    open_ = placed.join(main.drop("comps"), "grp")
    outside = open_.where("comp <> main")
    if best_only:
        outside = outside.groupBy("doc").agg(F.max_by(F.struct("grp", "comp", "total"), F.struct("total", "grp")).alias("x")).select("x.grp", "doc", "x.comp", "x.total")
    outside = materialise(outside.select("grp", "doc", "comp", "total"), "outside")
    slices = outside.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).alias("slices"))
    seat = lambda n: F.pmod(F.xxhash64("doc"), F.col(n))
    zero, columns = F.lit(0).cast("long"), ["doc", "comp"]
    blocks = F.ceil(F.col("total") / BLOCK)
    listed = open_.join(slices, "grp").withColumn("blocks", blocks).select(
        "grp", F.explode(F.sequence(zero, F.col("slices") - 1)).alias("j"), seat("blocks").alias("k"), F.lit(0).alias("role"), *columns
    )
    asking = outside.join(slices, "grp").withColumn("blocks", blocks).select(
        "grp", seat("slices").alias("j"), F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("k"), F.lit(1).alias("role"), *columns
    )
    rows = listed.union(asking).join(sketch, "doc").select(*UNIT, "role", "doc", "comp", "n", "sk")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def pairs() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            held.clear()
            found = _close({c: t.column(c).to_numpy() for c in ("role", "doc", "comp", "n")}, t.column("sk").to_pylist(), best_only)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, c])) for c in (0, 1)], names=["a", "b"])

        last = None
        for b in batches:
            keys = np.column_stack([b.column(c).to_numpy() for c in UNIT])
            starts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for x, y in zip([0, *starts], [*starts, b.num_rows], strict=True):
                if x == y:
                    continue
                if last is not None and last != tuple(keys[x]):
                    yield pairs()
                last = tuple(keys[x])
                held.append(b.slice(x, y - x))
        if held:
            yield pairs()

    return rows.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(tidy(run), "a long, b long").distinct()


LINKED = "100 * inter >= 75 * (na + nb - inter) AND inter > 0"


def links(texts: DataFrame, small_group: int = 12, sample_docs: int = 4000) -> tuple[DataFrame, DataFrame]:
    """Verified links ``a, b`` that connect all linked documents, and their components."""
    found = materialise(candidates(texts, small_group, sample_docs), "candidates")
    pairs = found.where("kind = 0").select("a", "b").distinct()
    members = found.where("kind = 1").select(F.col("a").alias("grp"), F.col("b").alias("doc")).distinct()
    wanted = pairs.select("a").union(pairs.select("b")).union(members.select("doc"))
    sketch = materialise(sketches(_only(texts, wanted)), "sketches")
    tried = materialise(near(pairs, sketch), "near")
    edges = similarity(tried, texts).where(LINKED).select("a", "b").union(found.where("kind = 2").select("a", "b"))
    edges = materialise(edges, "links")
    nodes = materialise(components(edges), "components")
    for best_only in (True, False):
        more = materialise(outsider_pairs(members, nodes, sketch, best_only).join(tried, ["a", "b"], "left_anti"), "rest-pairs")
        if more.isEmpty():
            continue
        late = materialise(similarity(more, texts).where(LINKED).select("a", "b"), "late-links")
        tried = tried.union(more)
        if not late.isEmpty():
            edges = edges.union(late)
            nodes = materialise(components(edges), "components")
    return edges, nodes


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small_group: int = 12, sample_docs: int = 4000) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id`` (least id reachable by links)."""
    texts = id_and_text(docs, id_col, text_col)
    _, nodes = links(texts, small_group, sample_docs)

    def batch(cols):
        return {"doc_id": cols["doc_id"], "n_shingles": [len(s) for s in sets_of(cols["text"])]}

    sizes = map_batches(texts, batch, "doc_id long, n_shingles long", binary=("text",))
    return sizes.join(nodes, sizes["doc_id"] == nodes["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component (the one with the least id); all columns are kept."""
    texts = id_and_text(docs, id_col, text_col)
    _, nodes = links(texts)
    drop = nodes.where("node <> component").select(F.col("node").alias("_drop_id"))
    return docs.join(drop, docs[id_col].cast("long") == drop["_drop_id"], "left_anti")
