"""Document fingerprints: MinHash over word shingles.

Words are runs of other characters than ASCII white space, with A-Z lowered;
shingles are SHINGLE consecutive words (a text of fewer words is one shingle, a
text of none has no shingle).  Each of PERMUTATIONS universal hash functions
(odd multiplier, addend, modulo 2^64) permutes the shingle hashes; the signature
holds the upper 32 bits of each minimum.  All of it is computed for a whole
Arrow batch at once in numpy.

Signatures agree in a component with the probability of the Jaccard similarity
of the shingle sets.  ``near_duplicates`` joins bands of the signatures in Spark
and verifies the Jaccard similarity of the colliding pairs on whole shingle sets.

Null texts are empty; all empty texts have one signature (all ones), unlike any
other text's.  Equal texts have equal signatures.  Every row has a result, also
repeated ones; an empty table gives an empty one.  Only the named id and text
columns are read, so further columns may have any name.  Texts of any length are
signed whole; a text is in memory once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, discard, lean, maybe, partitions, release, text_key, text_of, written
from .graph import components

SHINGLE = 5
PERMUTATIONS = 128
#: Bands of PERMUTATIONS // BANDS components: sets alike to 0.8 meet in one with a probability of 1 - 5e-5, to 0.85 of 1 - 1e-6.
BANDS = 25
SIMILARITY = 0.8
#: Shingles in one side of a comparison of blocks, about.
BLOCK = 1 << 16
#: Bytes of text that are hashed at once; the arrays for them take about a hundred times as many.
SLICE = 1 << 18
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
NONE = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permutations(n: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    draw = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return draw[:n] | np.uint64(1), draw[n:]


def shingle_hashes(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, and how many each text has."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    data = LOWER[data]
    ends = np.cumsum([len(t) + 1 for t in texts])
    blank = BLANKS[data]
    first = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    last = np.flatnonzero(~blank & np.append(blank[1:], True))
    # A word's hash: a polynomial in its bytes, from a table of powers by place in the word.
    lengths = last - first + 1
    width = int(lengths.max())
    powers = np.cumprod(np.append(np.uint64(1), np.full(width - 1, 0x100000001B3, np.uint64)), dtype=np.uint64)
    kept = np.flatnonzero(~blank)
    offset = np.cumsum(lengths) - lengths
    place = np.arange(len(kept)) - np.repeat(offset, lengths)
    word = np.add.reduceat((data[kept].astype(np.uint64) + np.uint64(1)) * powers[place], offset)
    word = _mix(word ^ lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    words = np.diff(np.append(0, np.searchsorted(first, ends)))
    count = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    # A shingle's hash folds its words in their order; short texts fold what they have.
    start = np.cumsum(words) - words
    at = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    left = np.minimum(np.repeat(words, count), size)
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        folded = _mix(out * np.uint64(31) + word[np.minimum(at + k, len(word) - 1)] + np.uint64(k + 1))
        out = np.where(k < left, folded, out)
    return out, count


def signatures(texts: list[bytes], size: int = SHINGLE, n: int = PERMUTATIONS) -> np.ndarray:
    """len(texts) x n components."""
    return minima(*shingle_hashes(texts, size), n)


def minima(hashes: np.ndarray, count: np.ndarray, n: int = PERMUTATIONS) -> np.ndarray:
    """The signatures of texts that have `count` of the shingle hashes each."""
    out = np.full((len(count), n), NONE >> np.uint64(32), "<u4")
    full = np.flatnonzero(count)
    if not len(full):
        return out
    offset = (np.cumsum(count) - count)[full]
    a, b = permutations(n)
    held = np.empty_like(hashes)
    for k in range(n):
        np.multiply(hashes, a[k], out=held)
        held += b[k]
        out[full, k] = np.minimum.reduceat(held, offset) >> np.uint64(32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(1)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, permutations: int = PERMUTATIONS) -> DataFrame:
    """id_col, signature (binary: little-endian unsigned 32-bit components), one row for each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in runs(batch.column(1), SLICE):
                sig = signatures(_bytes(batch.column(1).slice(low, high - low)), shingle, permutations)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array([x.tobytes() for x in sig], pa.binary())], [id_col, "signature"])

    return docs.select(id_col, text_col).mapInArrow(lean(run), f"{id_col} {kind}, signature binary")


def _bytes(texts: pa.Array) -> list[bytes]:
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def runs(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Slices of about `most` bytes of text."""
    low, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        held += n
        if held >= most:
            yield low, i + 1
            low, held = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


def in_order(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", notes: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """docs dealt out in ranges of id_col, each with the first row of the range after it.

    The result has bucket, follows (true: the row belongs to the next range), id_col, kind,
    text_key, text_col, note; each bucket is in one task, sorted by follows, id_col, kind, text.
    Kind 0 are notes (id, text_key, note: something about the rows alike in both), which stand
    before the rows of their id, kind 1.  The next of the last range is the first.  Range bounds
    are quantiles of the ids (some hundreds of numbers); texts are shuffled once.  Null ids and
    ids that are no number come first.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    wanted = buckets or 4 * n
    of = lambda c: F.coalesce(F.col(c).try_cast("long"), F.lit(-(2**63)))
    key = of(id_col)
    ids = docs.select(key.cast("double").alias("k"))
    bounds = sorted(set(ids.approxQuantile("k", [i / wanted for i in range(1, wanted)], 1 / (8 * wanted)))) or [0.0]
    # The number of bounds at or below the id: first among every some, then within the next some.
    some = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + some] for i in range(0, len(bounds), some)]
    at_most = lambda x: x <= F.col("_key").cast("double")
    coarse = F.size(F.filter(F.array(*[F.lit(g[-1]) for g in groups]), at_most))
    fine = F.size(F.filter(F.coalesce(F.get(F.array(*[F.array(*map(F.lit, g)) for g in groups]), coarse), F.array().cast("array<double>")), at_most))
    bucket = (coarse * some + fine).alias("bucket")
    none = F.lit(None)
    own = docs.select(F.col(id_col), F.lit(1).alias("kind"), text_key(text_col).alias("text_key"), text_of(text_col).alias(text_col), none.cast(docs.schema[id_col].dataType).alias("note"), key.alias("_key")).select(bucket, "*")
    least = sorted(map(tuple, own.groupBy("bucket").agg(F.min("_key")).collect()))  # one row for each range
    columns = ["bucket", "follows", id_col, "kind", "text_key", text_col, "note"]
    if not least:
        return own.withColumn("follows", F.lit(False)).select(*columns)
    prior = spark.createDataFrame([(b, k, least[i - 1][0]) for i, (b, k) in enumerate(least)], "_bucket int, _first long, _prior int")
    head = own.join(F.broadcast(prior), (own["bucket"] == prior["_bucket"]) & (own["_key"] == prior["_first"]))
    # The first by id, then text (ids that are no number share a key).
    head = head.groupBy("_prior").agg(F.min(F.struct(F.col(id_col).isNotNull().alias("no"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))).alias("m"))
    head = head.select(F.col("_prior").alias("bucket"), F.lit(True).alias("follows"), F.col("m.id").alias(id_col), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("text_key"), F.col("m.text").alias(text_col), none.cast(docs.schema[id_col].dataType).alias("note"))
    both = own.withColumn("follows", F.lit(False)).select(*columns).unionByName(head)
    if notes is not None:
        noted = notes.select(F.col(notes.columns[0]).alias(id_col), F.lit(0).alias("kind"), F.col(notes.columns[1]).alias("text_key"), F.lit("").alias(text_col), F.col(notes.columns[2]).alias("note"), of(notes.columns[0]).alias("_key"))
        both = both.unionByName(noted.select(bucket, "*").withColumn("follows", F.lit(False)).select(*columns))
    return both.repartition(n, "bucket").sortWithinPartitions("bucket", "follows", id_col, "kind", text_col)


def edited(text: str, following: str) -> str:
    """text, its last half of code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, permutations: int = PERMUTATIONS, notes: DataFrame | None = None) -> DataFrame:
    """Each document beside its edited text and its successor by id_col.

    id_col, n_chars, edited (string), signature, edited_signature (binary),
    near_edited, near_next, note.  One row for each row of docs; rows that share an id
    are ordered by text.  A sole document is its own successor.

    notes: id, text_key and what is to stand as the note (of id_col's type) of the rows
    alike in both, as near_duplicates() gives it; the notes travel with the texts.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def flush(held: list[tuple], following: str) -> pa.RecordBatch:
        texts = [t for _, t, _ in held]
        after = [*texts[1:], following]
        edits = [edited(t, u) for t, u in zip(texts, after, strict=True)]
        coded = [x.encode("utf-8", "surrogatepass") for x in [*texts, following, *edits]]
        sig = signatures(coded, shingle, permutations)
        n = len(texts)
        own, nxt, edit = sig[:n], sig[1 : n + 1], sig[n + 1 :]
        return pa.RecordBatch.from_pydict({
            id_col: pa.array([k for k, _, _ in held], id_type),
            "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "edited": pa.array([x.decode("utf-8", "surrogatepass") for x in coded[n + 1 :]], pa.string()),
            "signature": pa.array([x.tobytes() for x in own], pa.binary()),
            "edited_signature": pa.array([x.tobytes() for x in edit], pa.binary()),
            "near_edited": likeness(own, edit),
            "near_next": likeness(own, nxt),
            "note": pa.array([x for _, _, x in held], id_type),
        })

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row is ready when the one after it is known; the last of a bucket is followed by the borrowed row."""
        held: list[tuple] = []
        size, bucket = 0, None
        noted_of, noted = None, {}
        for batch in batches:
            for b, follows, key, kind, mark, text, note in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if follows:
                    if held:
                        yield flush(held, text)
                    held, size = [], 0
                    continue
                if noted_of != (b, key):
                    noted_of, noted = (b, key), {}
                if not kind:
                    noted[mark] = note
                    continue
                if held and (size >= SLICE or b != bucket):
                    yield flush(held, text)
                    held, size = [], 0
                held.append((key, text, noted.get(mark)))
                bucket, size = b, size + len(text)
        if held:
            yield flush(held, held[0][1])

    schema = f"{id_col} {kind}, n_chars long, edited string, signature binary, edited_signature binary, near_edited double, near_next double, note {kind}"
    return in_order(docs, id_col=id_col, text_col=text_col, notes=notes).mapInArrow(lean(run), schema)


def band_keys(hashes: np.ndarray, count: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """len(count) x bands hashes, one of each band of the signature."""
    rows = PERMUTATIONS // bands
    parts = minima(hashes, count, bands * rows).reshape(-1, bands, rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2])
    for r in range(rows):
        keys = _mix(keys * np.uint64(31) + parts[:, :, r] + np.uint64(r + 1))
    return keys


def classes(docs: DataFrame, sign: Callable[[np.ndarray, np.ndarray], np.ndarray], *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, text_key, node, n, keys, one row for each row of docs: a hash of the text's shingle set, the set's size, what sign() makes of it.

    Texts of equal sets are one class, the node; of two different sets two nodes, but for a chance of 2^-64.
    sign: the shingle hashes of some sets one after the other, and how many each has, to a row of unsigned 64-bit numbers for each.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in runs(batch.column(2), SLICE):
                part = batch.slice(low, high - low)
                sets, _, _ = _sets(_bytes(part.column(2)), shingle)
                size = np.array([len(x) for x in sets], np.int64)
                keys = sign(np.concatenate(sets), size)
                held = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel().view(np.int64)))
                node = [xxhash.xxh64_intdigest(x.tobytes(), 42) - 2**63 for x in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(node, pa.int64()), pa.array(size), held], ["id", "text_key", "node", "n", "keys"])

    return docs.select(id_col, text_key(text_col), text_col).mapInArrow(lean(run), f"id {kind}, text_key bigint, node bigint, n bigint, keys array<bigint>")


def _sets(texts: list[bytes], shingle: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The sorted set of shingle hashes of each text, all the hashes, and how many each text has."""
    hashes, count = shingle_hashes(texts, shingle)
    return [np.unique(x) for x in np.split(hashes, np.cumsum(count)[:-1])], hashes, count


def _packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sets of a binary column one after the other, and where each begins (and the last ends)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), np.uint64), (offsets - offsets[0]) // 8


def grouping(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, sign: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, meet: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, text_key, node of each row of docs), (node, m, label of each node): written tables.

    Texts link if the sets of their shingles have a Jaccard similarity of `similarity` or
    more; label tells the components of the links apart.  m: the node's first row by id (null
    ids last), then text_key, as a struct (no, id, key).

    Links are looked for among the texts that meet in a band, and decided on whole sets.  Or
    they meet as the caller has it: sign makes the keys of each set (see classes()), and meet
    a written table (node, key) of buckets from (node, n, keys).

    1. in each bucket (a band's value) all members are compared with its least node, so a
       bucket of any size costs as much as it has members;
    2. where the members of a bucket of three or more are still of several components, those
       outside the least node's are compared with all the others (blocks with blocks), pairs of
       one component left out.

    Nothing else is left: two members of one bucket are in one component, or were compared.
    """
    spark = docs.sparkSession
    sign = sign or partial(band_keys, bands=bands)
    own = written(classes(docs, sign, id_col=id_col, text_col=text_col, shingle=shingle))
    rank = F.struct(F.col("id").isNull().alias("no"), F.col("id").alias("id"), F.col("text_key").alias("key"))
    nodes = written(own.groupBy("node").agg(F.min(rank).alias("m"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    release(spark)
    emitted = meet(nodes.select("node", "n", "keys")).join(nodes.select("node", "n"), "node") if meet else nodes.select("node", "n", F.explode("keys").alias("key"))
    least = emitted.groupBy("key").agg(F.min("node").alias("a"), F.min_by("n", "node").alias("n_a"), F.count("*").alias("c")).where("c > 1")
    met = written(emitted.join(least, "key").select("key", "node", "n", "a", "n_a", "c"))
    release(spark)
    # Sets whose sizes are further apart than the similarity cannot be alike to it.
    fits = F.least("n", "n_a") / F.greatest("n", "n_a") >= similarity
    pairs = written(met.where((F.col("a") != F.col("node")) & fits).select("a", F.col("node").alias("b")).distinct())
    release(spark)
    crowd = met.where("c > 2").select("key", "node")
    members = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(crowd.select("node")).distinct().join(nodes.select("node", "m", "n"), "node"))
    # No text is shuffled: a bitmap of the members' first rows (at most 8 MB) tells whose sets are made.
    bits, longs = bitmap(members.select(F.xxhash64("m.id", "m.key").alias("h")), members.count())
    here = docs.select(F.col(id_col).alias("_own"), F.col(text_col).alias("_text"), text_key(text_col).alias("_of")).withColumn("_bits", bits)
    sets = written(_shingle_sets(here.where(maybe(F.col("_bits"), longs, F.xxhash64("_own", "_of"))), shingle))
    if not sets.groupBy("node").count().where("count > 1").isEmpty():  # rows alike in several tasks
        once = written(sets.dropDuplicates(["node"]))
        discard(sets)
        sets = once
    release(spark)
    found = written(_stars(pairs, sets, similarity))
    discard(pairs)
    star = components(found)
    discard(found)
    labelled = written(members.select("node", "n").join(star, "node", "left").withColumn("label", F.coalesce("label", "node")))
    release(spark)
    rest = written(_rest(labelled.join(crowd, "node"), sets, similarity))
    discard(sets, members, star, met)
    if not rest.isEmpty():
        joined = components(rest)
        moved = joined.select(F.col("node").alias("label"), F.col("label").alias("top"))
        wider = written(labelled.join(moved, "label", "left").select("node", F.coalesce("top", "label").alias("label")))
        discard(joined, labelled)
        labelled = wider
    discard(rest)
    label = written(nodes.select("node", "m").join(labelled.select("node", "label"), "node", "left").select("node", "m", F.coalesce("label", "node").alias("label")))
    slim = written(own.select("id", "text_key", "node"))
    discard(labelled, emitted, nodes, own)
    release(spark)
    return slim, label


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS) -> DataFrame:
    """id, text_key, cluster_id (the smallest id of the row's component of links), one row for each row of docs.

    See grouping().  Null ids have a cluster_id of their component's other rows, if there are any with an id.
    """
    rows, label = grouping(docs, id_col=id_col, text_col=text_col, shingle=shingle, similarity=similarity, bands=bands)
    top = written(label.groupBy("label").agg(F.min("m").alias("top"), F.count("*").alias("c")).where("c > 1").select("label", F.col("top.id").alias("_top")))
    named = written(label.join(top, "label", "left").select("node", F.when(F.col("_top").isNotNull(), F.col("_top")).otherwise(F.col("m.id")).alias("cluster_id")))
    discard(label, top)
    found = written(rows.join(named, "node").select("id", "text_key", "cluster_id"))
    discard(rows, named)
    release(docs.sparkSession, 2)
    return found


def _stars(pairs: DataFrame, sets: DataFrame, similarity: float, share: int = 128) -> DataFrame:
    """Those of the pairs (a, b; distinct) whose sets are alike.  A node's partners are dealt out over tasks by `share`, each with a copy of its set."""
    spark = pairs.sparkSession
    counted = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / share).cast("int").alias("shares")))
    dealt = written(pairs.join(counted, "a").select("a", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"), "b"))
    both = dealt.select("a", "share", F.lit(1).alias("kind"), F.col("b").alias("node")).unionByName(dealt.select("a", "share", F.lit(0).alias("kind"), F.col("a").alias("node")).distinct())
    rows = both.join(sets, "node").repartition(partitions(spark), "a", "share").sortWithinPartitions("a", "share", "kind", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, np.uint64)
        for batch in batches:
            for low, high in runs(batch.column(4), 4 << 20):
                part = batch.slice(low, high - low)
                a, node = part.column(0).to_numpy(), part.column(3).to_numpy()
                data, at = _packed(part.column(4))
                size = np.diff(at)
                centres = np.flatnonzero(part.column(2).to_numpy() == 0).tolist()
                near = np.zeros(len(a), bool)
                for begin, end in zip([-1, *centres], [*centres, len(a)], strict=True):
                    if begin >= 0:
                        centre = data[at[begin] : at[begin + 1]]
                    if begin + 1 < end:
                        own = data[at[begin + 1] : at[end]]
                        same = centre[np.minimum(np.searchsorted(centre, own), len(centre) - 1)] == own
                        common = np.add.reduceat(same.astype(np.int64), at[begin + 1 : end] - at[begin + 1])
                        near[begin + 1 : end] = common / (size[begin + 1 : end] + len(centre) - common) >= similarity
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[near], node[near])), pa.array(np.maximum(a[near], node[near]))], ["a", "b"])

    return rows.select("a", "share", "kind", "node", "shingles").mapInArrow(lean(run), "a bigint, b bigint")


def _rest(members: DataFrame, sets: DataFrame, similarity: float, block: int | None = None) -> DataFrame:
    """members: node, n, label, key (one row for each bucket of a member).  Edges a, b between the labels of alike members of a bucket, enough to span them.

    Only buckets of several labels count.  Their members outside the least node's label
    (outer) are dealt into blocks of about BLOCK shingles, the others (inner) too; each outer
    block meets each inner block, itself and each later outer block.
    """
    spark = members.sparkSession
    block = block or BLOCK
    mixed = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.struct("node", "label")).alias("first"), F.bit_xor(F.xxhash64("node")).alias("who"), F.count("*").alias("c")).where("low <> high")
    # Buckets of the same members (told by 64 bits of their nodes, their number and the least) are one: those of two bands often are.
    mixed = written(mixed.groupBy("who", "c", "first").agg(F.min("key").alias("key")).select("key", F.col("first.label").alias("main")))
    placed = written(members.join(mixed, "key").withColumn("outer", F.col("label") != F.col("main")).drop("main"))
    release(spark)
    size = lambda c: F.greatest(F.lit(1), F.ceil(F.sum(F.when(c, F.greatest("n", F.lit(1))).otherwise(0)) / block)).cast("int")
    blocks = written(placed.groupBy("key").agg(size(F.col("outer")).alias("outers"), size(~F.col("outer")).alias("inners")))
    dealt = placed.join(blocks, "key").withColumn("i", F.pmod(F.xxhash64("node"), F.when(F.col("outer"), F.col("outers")).otherwise(F.col("inners"))).cast("int"))
    # The other side j: an inner block, or -1 - an outer block.
    sides = dealt.withColumn("j", F.explode(F.when(F.col("outer"), F.sequence(-F.col("outers"), F.col("inners") - 1)).otherwise(F.sequence(F.lit(0), F.col("outers") - 1))))
    other = -1 - F.col("j")
    between = F.col("outer") & (F.col("j") < 0)
    sides = sides.select(
        "key",
        F.when(~F.col("outer"), F.col("j")).when(between, F.least("i", other)).otherwise(F.col("i")).alias("x"),
        F.when(~F.col("outer"), F.col("i")).when(between, -1 - F.greatest("i", other)).otherwise(F.col("j")).alias("y"),
        (F.col("outer") & (~between | (F.col("i") <= other))).alias("left"),
        (~F.col("outer") | (between & (F.col("i") >= other))).alias("right"),
        "node",
        "label",
    )
    rows = sides.join(sets, "node").repartition(partitions(spark), "key", "x", "y").sortWithinPartitions("key", "x", "y", F.octet_length("shingles"), "node")

    def compare(group: pa.Table) -> pa.RecordBatch:
        label = group.column("label").to_numpy()
        held = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]
        merged = _alike(held, label, group.column("left").to_numpy(), group.column("right").to_numpy(), similarity)
        moved = merged != label
        return pa.RecordBatch.from_arrays([pa.array(merged[moved], pa.int64()), pa.array(label[moved], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for low, high in runs(batch.column(6), 1 << 20):
                some = batch.slice(low, high - low)
                keys = np.stack([some.column(c).to_numpy() for c in range(3)], 1).astype(np.int64)
                begin = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))).tolist()
                for at, end in zip(begin, [*begin[1:], len(keys)], strict=True):
                    if held and keys[at].tolist() != last:
                        yield compare(pa.Table.from_batches(held))
                        held = []
                    held.append(some.slice(at, end - at))
                    last = keys[at].tolist()
        if held:
            yield compare(pa.Table.from_batches(held))

    return rows.select("key", "x", "y", "left", "right", "label", "shingles").mapInArrow(lean(run), "a bigint, b bigint").distinct()


def _alike(sets: list[np.ndarray], label: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """The labels, merged (to the least) by the links between members marked left and members marked right; sets in the order of their size."""
    size = np.array([len(x) for x in sets])
    label = label.copy()
    if len(set(label.tolist())) == 1:
        return label
    offset = np.append(0, np.cumsum(size))
    vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.zeros(len(vocabulary), bool)
    for i in np.flatnonzero(left & (size > 0)).tolist():
        fits = right & (label != label[i]) & (np.minimum(size, size[i]) / np.maximum(size, size[i]) >= similarity)
        others = np.flatnonzero(fits)
        if not len(others):
            continue
        low, high = int(others[0]), int(others[-1]) + 1
        own[ids[offset[i] : offset[i + 1]]] = True
        common = np.add.reduceat(own[ids[offset[low] : offset[high]]].astype(np.int64), offset[low:high] - offset[low])[others - low]
        own[ids[offset[i] : offset[i + 1]]] = False
        near = others[common / (size[others] + size[i] - common) >= similarity]
        if len(near):
            trees = np.unique(np.append(label[near], label[i]))
            label[np.isin(label, trees)] = trees[0]
    return label


def _shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """texts: _text.  node (as in classes()), shingles (binary: the sorted set of hashes, 64 bits each); each node once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for low, high in runs(batch.column(0), SLICE):
                own = {}
                for x in _sets(_bytes(batch.column(0).slice(low, high - low)), shingle)[0]:
                    held = x.tobytes()
                    own[xxhash.xxh64_intdigest(held, 42) - 2**63] = held
                own = {node: held for node, held in own.items() if node not in seen}
                seen |= own.keys()
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.binary())], ["node", "shingles"])

    return texts.select("_text").mapInArrow(lean(run), "node bigint, shingles binary")
