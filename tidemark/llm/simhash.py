"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's words are runs of other characters than ASCII white space, A-Z lowered;
its shingles (repeats counted) are `shingle` words joined by a space, the whole
sequence where it is shorter.  Bit i of the fingerprint is 1 if bit i is set in
over half of the shingles' XXH64 hashes (seed 42).  `width` 64-bit words make a
fingerprint; the first has the hashes as they are, further ones rehashed.

Fingerprints link at `radius` or fewer differing bits.  Each is cut into parts of
32 bits; if two link, they differ in some part by no more than radius / parts
bits (2 with the defaults).  Both emit all variants of each part within half of
that (33 for a radius of 1), so that they meet in the middle: in a shuffle on the
variants.  Colliding pairs are verified on the whole fingerprints.  Variants of
the whole 64 bits within 2 would be 2,081 for each fingerprint instead of 66.

Equal fingerprints are one class from the start, so copies cost nothing.
Buckets of more than BLOCK fingerprints are compared block by block; a task
gives, for what it compares, no more edges than fingerprints (a spanning
forest).  Components are found by contraction, on Spark (``graph``).

keep_one() is about a given similarity of the shingle sets, at which fingerprints
differ in some 15 % of their bits: it takes wider fingerprints of the sets, cut into
many short parts, whose balls meet in the same way (``shape``, ``short_links``);
whole fingerprints are compared next, and within their components whole shingle sets
decide.  Its words and
shingles are those of minhash.

Null and empty texts have no words: fingerprint zero, linked like any other.
Every row of docs has a row in the result, also repeated ones; the smallest id
reachable leaves out null ids (null if there is no other).  An empty table gives
an empty one.  Texts of any length count whole.  Only the id and text columns are
read; keep_one() gives all columns back as they were, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import minhash
from .common import bitmap, discard, lean, maybe, partitions, release, text_key, written
from .graph import _held, components
from .minhash import _mix, runs

BLOCK = 1024
PART_BITS = 32
#: For keep_one(): the chance to miss a pair at the similarity, strangers in a bucket (about, at most), bits of the shortest part.
MISS, STRANGERS, LEAST_BITS = 1e-5, 64, 16
_LANES = np.uint64(0x0000000100000001)


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.append(0, end[: len(words) - size] + 1).tolist()
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(joined[i:j], 42) for i, j in zip(start, end[size - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint_rows(texts: list[bytes], size: int, width: int = 1) -> np.ndarray:
    """len(texts) x width, unsigned."""
    each = [shingle_hashes(t, size) for t in texts]
    return majorities(np.concatenate([np.zeros(0, np.uint64), *each]), np.array([len(x) for x in each], np.int64), width)


def majorities(hashes: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
    """The fingerprints (len(count) x width, unsigned) of texts that have `count` of the hashes each."""
    out = np.zeros((len(count), width), np.uint64)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    offset = (np.cumsum(count) - count)[full]
    most = count[full].astype(np.uint64)
    for k in range(width):
        own = hashes if not k else _mix(hashes + np.uint64(0x9E3779B97F4A7C15 * k % 2**64))
        for bit in range(32):  # two bits at once, in lanes of 32 bits
            sums = np.add.reduceat((own >> np.uint64(bit)) & _LANES, offset)
            low, high = sums & np.uint64(0xFFFFFFFF), sums >> np.uint64(32)
            out[full, k] |= (low * np.uint64(2) > most).astype(np.uint64) << np.uint64(bit)
            out[full, k] |= (high * np.uint64(2) > most).astype(np.uint64) << np.uint64(bit + 32)
    return out


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, width: int = 1) -> DataFrame:
    """id_col, fingerprint (array of `width` longs), one row for each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in runs(batch.column(1)):
                texts = [x or b"" for x in batch.column(1).slice(low, high - low).cast(pa.binary()).to_pylist()]
                rows = fingerprint_rows(texts, shingle, width).view(np.int64)
                held = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, width), pa.int32()), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), held], [id_col, "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(lean(run), f"{id_col} {kind}, fingerprint array<bigint>")


def _ball(reach: int, bits: int = PART_BITS) -> list[int]:
    """Masks of at most `reach` of `bits` bits."""
    found, last = [0], [0]
    for _ in range(reach):
        last = sorted({m | 1 << b for m in last for b in range(bits) if not m >> b & 1})
        found += last
    return found


def _pairs_within(tree: np.ndarray, words: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each first member of a tree beside the first one of the tree that it comes to be in, by the links between members marked left and members marked right.

    tree: for each member (of ascending nodes) the first one that is known to be of its component.
    Buckets that hold the same fingerprints thus give the same edges.
    """
    i, j = np.flatnonzero(left), np.flatnonzero(right)
    label = tree.copy()
    step = max(1, (1 << 20) // max(1, len(j)))
    for low in range(0, len(i), step):
        own = i[low : low + step]
        apart = sum(np.bitwise_count(words[own, None, k] ^ words[None, j, k]).astype(np.int32) for k in range(words.shape[1]))
        a, b = np.nonzero(apart <= radius)
        a, b = own[a], j[b]
        while len(a):
            x, y = label[a], label[b]
            still = x != y
            a, b, x, y = a[still], b[still], x[still], y[still]
            if not len(a):
                break
            high, at = np.unique(np.maximum(x, y), return_index=True)
            label[high] = np.minimum(x, y)[at]  # a root is hung below a smaller one: no cycle
            while (label[label] != label).any():
                label = label[label]
    member = np.flatnonzero((tree == np.arange(len(tree))) & (label != tree))
    return member, label[member]


def links(nodes: DataFrame, *, radius: int = 4, reach: int | None = None, block: int = BLOCK) -> DataFrame:
    """nodes: distinct node (long), fingerprint (array).  Edges a, b that span the components of links.

    reach: how many bits of a part its variants change; by default enough to find every
    link.  With less, those of up to parts * (2 * reach + 1) - 1 bits are all found.
    """
    spark = nodes.sparkSession
    width = len(nodes.select("fingerprint").head()[0]) if not nodes.isEmpty() else 1
    parts = width * 64 // PART_BITS
    reach = (radius // parts + 1) // 2 if reach is None else reach
    masks = F.array(*[F.lit(m).cast("long") for m in _ball(reach)])

    def part(i: int):
        word = F.get("fingerprint", i // 2)
        return (F.shiftrightunsigned(word, 32) if i % 2 else word).bitwiseAND(0xFFFFFFFF)

    variants = F.flatten(F.array(*[_moved(masks, part(p), p) for p in range(parts)]))
    # Nodes are few and narrow, variants many: they are made in as many tasks as a shuffle has.
    emitted = nodes.repartition(partitions(spark), "node").select("node", F.explode(variants).alias("key"))
    full = emitted.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    own = emitted.join(full, "key").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    sides = own.select("key", "node", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    sides = sides.select("key", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high"), (F.col("i") <= F.col("j")).alias("left"), (F.col("i") >= F.col("j")).alias("right"), "node")
    if width == 1:
        sides = sides.withColumn("fingerprint", F.array("node"))
    else:
        sides = sides.join(nodes, "node")
    sides = sides.repartition(partitions(spark), "key", "low", "high").sortWithinPartitions("key", "low", "high", "node")

    def compare(keys: np.ndarray, node: np.ndarray, words: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[list, list]:
        begin = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
        size = np.diff(np.append(begin, len(keys)))
        two = begin[size == 2]
        apart = sum(np.bitwise_count(words[two, k] ^ words[two + 1, k]).astype(np.int32) for k in range(words.shape[1]))
        met = two[(apart <= radius) & (left[two] & right[two + 1] | left[two + 1] & right[two])]
        a, b = node[met].tolist(), node[met + 1].tolist()
        for low, n in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            at = slice(low, low + n)
            i, j = _pairs_within(np.arange(n), words[at], left[at], right[at], radius)
            a += node[at][i].tolist()
            b += node[at][j].tolist()
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> pa.RecordBatch:
            keys = np.stack([rows.column(c).to_numpy() for c in ("key", "low", "high")], 1).astype(np.int64)
            words = rows.column("fingerprint").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, width)
            a, b = compare(keys, rows.column("node").to_numpy(), words, rows.column("left").to_numpy(), rows.column("right").to_numpy())
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b) if a else [], pa.int64()), pa.array(np.maximum(a, b) if a else [], pa.int64())], ["a", "b"])

        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            keys = [rows.column(c).to_numpy() for c in ("key", "low", "high")]
            other = np.flatnonzero((keys[0] != keys[0][-1]) | (keys[1] != keys[1][-1]) | (keys[2] != keys[2][-1]))
            if len(other):  # the last group may go on
                done = int(other[-1]) + 1
                yield flush(rows.slice(0, done))
                held = rows.slice(done).combine_chunks().to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    return sides.select("key", "low", "high", "left", "right", "node", "fingerprint").mapInArrow(lean(run), "a bigint, b bigint").where("a <> b").distinct()


def _moved(masks, value, part: int, bits: int = PART_BITS):
    """The variants of a part, each with the part's number above its bits."""
    return F.transform(masks, lambda m: value.bitwiseXOR(m).bitwiseOR(F.lit(part << bits).cast("long")))


def shape(n: int, similarity: float) -> tuple[int, int, int, int]:
    """Bits of a part, parts, 64-bit words of a fingerprint and the radius, for n sets whose links are at `similarity` or more.

    Sets of that Jaccard similarity differ in a bit with a probability of p at most (the angle of
    their vectors over pi; sets of a few shingles vary about it).  Parts meet at 2 or fewer
    differing bits, and there are enough of them that a pair fails to meet with a probability
    below MISS.  The radius lies 5.5 deviations above what such a pair differs in.  The more
    sets, the longer are the parts, so that about STRANGERS meet in a bucket by chance.
    """
    bits = LEAST_BITS
    while bits < PART_BITS and n * (bits + 1) > STRANGERS << bits:
        bits += 1
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    meet = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(3))
    words = math.ceil(math.log(MISS) / math.log1p(-meet) / (64 // bits)) if meet < 1 else 1
    all_bits = 64 * words
    return bits, words * (64 // bits), words, math.ceil(all_bits * p + 5.5 * math.sqrt(all_bits * p * (1 - p)))


def short_links(nodes: DataFrame, *, bits: int, parts: int, radius: int, block: int = BLOCK, at_once: int = 4) -> DataFrame:
    """links() for wide fingerprints in parts of a few bits, of which many strangers share one; a written table.

    nodes: distinct node (long), fingerprint (array).  Edges a, b (a < b) that span the components
    of the links between nodes that are within the radius, and within 2 bits in some part.

    1. where nodes are equal in a part, all are compared with the least of them; the components
       of these links are the nodes' labels (large groups have few, however many members);
    2. all variants of each part within one bit are shuffled, and the nodes of each bucket that
       are of different labels compared; what comes of it are edges between labels.

    Of buckets that may have more than `block` nodes, those of one label go no further.  In the
    others the nodes outside the most frequent label (outer) are dealt into blocks, and the inner
    ones too; outer blocks meet all blocks, inner ones not each other.
    Parts are taken `at_once`, as many variants are on disk together.
    """
    spark = nodes.sparkSession
    per, width = 64 // bits, -(-parts // (64 // bits))
    masks = F.array(*[F.lit(m).cast("long") for m in _ball(1, bits)])
    words = [f"w{k}" for k in range(width)]
    nodes = nodes.select("node", *[F.get("fingerprint", k).alias(w) for k, w in enumerate(words)])
    value = lambda p: F.shiftrightunsigned(words[p // per], bits * (p % per)).bitwiseAND((1 << bits) - 1)
    variants = lambda p, v: _moved(masks, v, p, bits)
    n = partitions(spark)
    own_values = F.array(*[value(p).bitwiseOR(F.lit(p << bits).cast("long")) for p in range(parts)])
    star = _part_stars(nodes, own_values, words, radius)
    label = components(star)
    discard(star)
    nodes = written(nodes.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")))

    # Of a bucket's more than `block` nodes, some value of its ball has over block / (bits + 1): those buckets are few.
    tally = nodes.select("label", F.explode(own_values).alias("value")).groupBy("value", "label").count()
    heavy = tally.groupBy("value").agg(F.sum("count").alias("c")).where(F.col("c") > block // (bits + 1))
    moved = lambda c: F.explode(F.transform(masks, lambda m: F.col(c).bitwiseXOR(m)))
    heavy = _held(heavy.select(moved("value").alias("key")).distinct().select("key", moved("key").alias("value")))
    release(spark)
    # What is in their buckets: so many nodes of each label, not the nodes themselves.
    counts = tally.join(heavy, "value").groupBy("key", "label").agg(F.sum("count").alias("count"))
    counts = counts.groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.max("count").alias("inner"), (F.sum("count") - F.max("count")).alias("outer"))
    hot = _held(counts.where(F.col("inner") + F.col("outer") > block).select("key", "main", F.ceil(F.col("inner") / block).cast("int").alias("inners"), F.ceil(F.col("outer") / block).cast("int").alias("outers")))
    discard(heavy)
    release(spark)
    n_hot = hot.count()
    # A bitmap tells which rows may be of these buckets (with the shortest parts, which are), so that no others are joined.
    bits_of, longs = bitmap(hot.select(F.col("key").alias("h")), max(n_hot, 1 << 15))
    may = maybe(bits_of, longs, F.col("key"))

    held = []
    for low in range(0, parts, at_once):
        emitted = nodes.repartition(n, "node").select("node", "label", *words, F.explode(F.flatten(F.array(*[variants(p, value(p)) for p in range(low, min(parts, low + at_once))]))).alias("key"))
        columns = ["key", "x", "y", "side", "label", "node", *words]
        none = F.lit(0)
        rows = (emitted.where(~may) if n_hot else emitted).select("*", none.alias("x"), none.alias("y"), F.lit(3).alias("side")).select(*columns)
        if n_hot:
            rows = rows.unionByName(_dealt(emitted.where(may).join(hot, "key", "left")).select(*columns))
        rows = rows.repartition(n, "key", "x", "y").sortWithinPartitions("key", "x", "y", "label", "node")
        held.append(written(_between_labels(rows, words, radius).distinct()))
        release(spark)
    every = label.select(F.col("label").alias("a"), F.col("node").alias("b"))
    for more in held:
        every = every.unionByName(more)
    every = written(every.distinct())
    discard(hot, label, nodes, *held)
    return every


def _dealt(rows: DataFrame) -> DataFrame:
    """rows: key, label, node, main, inners, outers (null: not of a hot bucket).  Adds x, y, side: each row once for each pair of blocks in which it is compared; not at all if its bucket has but one label."""
    outer, cold = F.col("label") != F.col("main"), F.col("outers").isNull()
    rows = rows.where("outers is null or outers > 0")
    rows = rows.withColumn("i", F.when(cold, 0).otherwise(F.pmod(F.xxhash64("node"), F.when(outer, F.col("outers")).otherwise(F.col("inners"))).cast("int")))
    # The other side j: an outer block, or -1 - an inner block.
    rows = rows.withColumn("j", F.explode(F.when(cold, F.array(F.lit(0))).when(outer, F.sequence(-F.col("inners"), F.col("outers") - 1)).otherwise(F.sequence(F.lit(0), F.col("outers") - 1))))
    i, j = F.col("i"), F.col("j")
    x = F.when(cold, 0).when(~outer, j).when(j < 0, i).otherwise(F.least(i, j))
    y = F.when(cold, 0).when(~outer, -1 - i).when(j < 0, j).otherwise(F.greatest(i, j))
    side = F.when(cold, 3).when(~outer, 1).when(j < 0, 2).otherwise((i <= j).cast("int") * 2 + (i >= j).cast("int"))
    return rows.withColumn("x", x).withColumn("y", y).withColumn("side", side)


def _part_stars(nodes: DataFrame, keys: Column, words: list[str], radius: int) -> DataFrame:
    """Edges a, b (a < b), a written table: of the nodes that share one of the keys, those within the radius of the least one.

    What is joined with a hot key is a written table, so that Spark can split it.
    """
    spark = nodes.sparkSession
    own = nodes.repartition(partitions(spark), "node").select("node", *words, F.explode(keys).alias("key"))
    first = nodes.select(F.col("node").alias("a"), *[F.col(w).alias(f"a{w}") for w in words])
    least = written(own.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("c")).where("c > 1").drop("c").join(first, "a"))
    release(spark)
    apart = reduce(add, [F.bit_count(F.col(w).bitwiseXOR(F.col(f"a{w}"))) for w in words])
    star = written(own.join(least, "key").where((F.col("a") < F.col("node")) & (apart <= radius)).select("a", F.col("node").alias("b")).distinct())
    discard(least)
    release(spark)
    return star


def _between_labels(rows: DataFrame, words: list[str], radius: int) -> DataFrame:
    """rows: key, x, y, side (2: left, 1: right), label, node, words, sorted by these.  Edges a, b (a < b) between the labels that have links from left to right in a group of key, x, y, enough to span them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches, ("key", "x", "y")):
            keys, label, side = [rows.column(c).to_numpy() for c in ("key", "x", "y")], rows.column("label").to_numpy(), rows.column("side").to_numpy()
            print_of = np.stack([rows.column(w).to_numpy().view(np.uint64) for w in words], 1)
            begin = np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))
            end = np.append(begin[1:], len(label))
            mixed = label[begin] != label[end - 1]  # they are sorted
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for low, high in zip(begin[mixed].tolist(), end[mixed].tolist(), strict=True):
                own, at = label[low:high], slice(low, high)
                new = np.append(True, own[1:] != own[:-1])
                tree = np.flatnonzero(new)[np.cumsum(new) - 1]
                left, right = side[at] >= 2, side[at] % 2 == 1
                if left.all() and right.all():  # each two are of different labels, or one of them is not of the most frequent
                    left = tree != np.bincount(tree).argmax()
                member, root = _pairs_within(tree, print_of[at], left, right, radius)
                a.append(own[root])
                b.append(own[member])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return rows.mapInArrow(lean(run), "a bigint, b bigint")


def _meetings(nodes: DataFrame, **options) -> DataFrame:
    """nodes: node, n, keys (its fingerprint).  node, key, a written table: the component by short_links() of each node that has links.

    Empty sets have none: they are alike to no other.
    """
    found = short_links(nodes.where("n > 0").select("node", F.col("keys").alias("fingerprint")), **options)
    label = components(found)
    own = label.select("node", F.col("label").alias("key"))
    every = written(own.unionByName(own.select(F.col("key").alias("node"), "key").distinct()))
    discard(found, label)
    return every


def _buckets(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows, which are sorted by the columns `by`, in tables that hold all rows of each of their groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        keys = [batch.column(c).to_numpy() for c in by]
        other = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))
        if not len(other) and len(held) > 1:  # the last group may be the one of the batch before
            before = [held[-2].column(c)[-1].as_py() for c in by]
            other = np.zeros(0 if before == [k[-1] for k in keys] else 1, np.int64) - 1
        if len(other):  # the last group may go on
            done = int(other[-1]) + 1
            if len(held) > 1 or done:
                yield pa.Table.from_batches([*held[:-1], batch.slice(0, done)])
            held = [batch.slice(done)]
    if held:
        yield pa.Table.from_batches(held)


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, width: int, radius: int, reach: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows (id_col, text_key, fingerprint, node), and node, _least (its smallest id), label: the component of each fingerprint."""
    keyed = docs.select(F.col(id_col), F.struct(F.col(id_col).alias("id"), text_key(text_col).alias("key")).alias("_row"), F.col(text_col))
    own = fingerprints(keyed.drop(id_col), id_col="_row", text_col=text_col, shingle=shingle, width=width)
    own = own.select(F.col("_row.id").alias(id_col), F.col("_row.key").alias("text_key"), "fingerprint", (F.get("fingerprint", 0) if width == 1 else F.xxhash64("fingerprint")).alias("node"))
    own = written(own)
    nodes = written(own.groupBy("node").agg(F.first("fingerprint").alias("fingerprint"), F.min(id_col).alias("_least")))
    found = written(links(nodes.select("node", "fingerprint"), radius=radius, reach=reach))
    label = components(found)
    known = written(nodes.select("node", "_least").join(label, "node", "left").select("node", "_least", F.coalesce("label", "node").alias("label")))
    discard(found, label, nodes)
    return own, known


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, width: int = 1, radius: int = 4, reach: int | None = None) -> DataFrame:
    """id_col, fingerprint (array of longs), component_id (the smallest id reachable by links); one row for each row of docs.

    The smallest id is that of each fingerprint first, then of each component.  What is joined
    with a hot component or fingerprint is a written table, so that Spark can split it.
    """
    own, known = _grouped(docs, id_col, text_col, shingle, width, radius, reach)
    top = written(known.groupBy("label").agg(F.min("_least").alias("_top"), F.count("*").alias("c")).where("c > 1").drop("c"))
    named = written(known.join(top, "label", "left").select("node", F.coalesce("_top", "_least").alias("component_id")))
    discard(known, top)
    return own.join(named, "node").select(id_col, "fingerprint", "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest id (null ids last, then by text hash); columns as they were.

    Groups are components of links between texts whose shingle sets are alike to `similarity`:
    looked for in the components of their fingerprints (``short_links``), and decided on the
    whole sets (minhash.grouping()).
    Rows alike in id and text (null texts are empty) are one document: the first of them by their
    other columns stays.
    """
    bits, parts, width, radius = shape(docs.count(), similarity)
    meet = partial(_meetings, bits=bits, parts=parts, radius=radius)
    rows, label = minhash.grouping(docs, id_col=id_col, text_col=text_col, shingle=shingle, similarity=similarity, sign=partial(majorities, width=width), meet=meet)
    top = written(label.groupBy("label").agg(F.min("m").alias("m")).select(F.col("m.id").alias("_id"), F.col("m.key").alias("_key")))
    twice = written(rows.groupBy("id", "text_key").count().where("count > 1").select(F.col("id").alias("_id"), F.col("text_key").alias("_key")))
    discard(rows, label)
    release(docs.sparkSession, 2)
    same = lambda df, other: df[id_col].eqNullSafe(other["_id"]) & (text_key(text_col) == other["_key"])
    out = docs.join(top, same(docs, top), "left_semi")
    if twice.isEmpty():
        discard(twice)
        return out
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = out.join(twice, same(out, twice), "left_semi").groupBy(F.col(id_col).alias("_id"), text_key(text_col).alias("_key")).agg(F.min_by(whole, F.struct(F.col(text_col).isNull().alias("no"), F.to_json(whole).alias("all"))).alias("_row"))
    return out.join(twice, same(out, twice), "left_anti").unionByName(repeated.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns]))
