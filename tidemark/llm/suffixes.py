"""Suffix-array deduplication of exact repeats in whole texts.

Each byte covered by a string of SPAN bytes that also starts earlier (smaller id,
or the same document and an earlier start) is removed.

Whole-corpus suffixes are not sorted in one place.  Every SPAN-byte window elects
an anchor, the gram of GRAM bytes of least hash in it (the first of equals), from
its own bytes alone; so equal windows elect equal anchors at equal offsets.  The
consecutive windows of one anchor are a segment, and every window is in exactly
one.  Then

1. anchors that occur once are dropped (nothing in their segments repeats);
2. segments with equal bytes are one class: all but the earliest are removed
   whole (a pre-aggregation: groups of copies never meet in a task);
3. classes that share an anchor may share a part: their segments meet by anchor,
   and a suffix array of them finds the equal windows: suffixes smaller than
   their successors are sorted directly, the others are induced by scans over the
   buckets, and adjacent common prefixes of SPAN bytes make groups, in each of
   which all but the earliest are removed;
4. an anchor with more than MANY classes would be too much for one task: its segments
   go through the same steps again with longer grams (GRAMS), which tell them apart by
   more of what is around; a gram as long as the window leaves one class an anchor.

Anchors and classes that hold a large share of all rows are dealt out over several
tasks wherever rows meet by them.

Equality of segments (step 2) is that of two hashes of 64 bits each, of the anchor and
of all grams with their places; the windows of step 3 are compared by their bytes.

Null texts are empty; texts of fewer than SPAN bytes are kept.  Ids are integers;
null ids come first.  Different texts that share an id are told apart, and ordered, by
64 bits of a hash of the text; rows alike in id and text are one document and have its
result each.  An empty table gives an empty one; further columns may have any name.
Texts longer than PIECE bytes are scanned in pieces that overlap by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_dealt, partitions, release, text_key, text_of, written
from .minhash import _mix, runs

SPAN = 100
GRAM = 24
#: The grams that anchor windows: of texts, and of the segments of crowded anchors, and of theirs.
GRAMS = (GRAM, 64, SPAN)
#: Classes of an anchor that one task takes: their segments have about 150 bytes each, the direct sort a hundred times half of that.
MANY = 4096
PIECE = 4 << 20
BLOCK = 1 << 18
LEAST = -(2**63)
_RANDOM = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_R = 0x9FB21C651E98DF25


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_R, n, 1 << 64))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """The hash of the `gram` bytes from each place, by doubling."""
    hashed, length, out, done = _RANDOM[data], 1, None, 0
    while True:
        if gram & length:
            out = hashed if out is None else out[: len(data) - done - length + 1] * _power(length) + hashed[done : done + len(data) - done - length + 1]
            done += length
        if length * 2 > gram:
            return _mix(out)
        hashed = hashed[: len(hashed) - length] * _power(length) + hashed[length:]
        length *= 2


def segments(data: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """anchor (hash), content (hash), first window, number of windows, of one stretch of bytes; len(data) < 2^24."""
    if len(data) < span:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    hashed = gram_hashes(data, gram)
    place = np.arange(len(hashed), dtype=np.uint64)
    least = (hashed & ~np.uint64(0xFFFFFF)) | place
    reach, width = span - gram + 1, 1
    while width * 2 <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < reach:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    count = np.diff(np.append(first, len(anchor)))
    # Content: the bytes first .. first + count + span - 1, by differences of a running polynomial.
    at = anchor[first]
    return hashed[at], _content(hashed, first, count + span - gram, at), first, count


def _content(hashed: np.ndarray, first: np.ndarray, grams: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """A hash of all grams from first on, weighted by their place beside the anchor (so equal strings at equal offsets are equal)."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed, dtype=np.uint64)])
    place = np.arange(len(hashed), dtype=np.uint64)
    weighted = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed * place, dtype=np.uint64)])
    squared = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed * place * place, dtype=np.uint64)])
    last, a = first + grams, first.astype(np.uint64)
    s0, s1, s2 = (x[last] - x[first] for x in (total, weighted, squared))
    # Moments about the segment's start do not depend on where it stands.
    m1 = s1 - a * s0
    m2 = s2 - np.uint64(2) * a * s1 + a * a * s0
    return _mix(_mix(_mix(s0) + m1) + m2 * np.uint64(0x9E3779B97F4A7C15) + grams.astype(np.uint64) + (anchor - first).astype(np.uint64) * np.uint64(_R))


def pieces(data: np.ndarray, span: int = SPAN) -> Iterator[tuple[int, np.ndarray]]:
    """Stretches that hold every window once."""
    for low in range(0, max(1, len(data) - span + 1), PIECE):
        yield low, data[low : low + PIECE + span - 1]


def suffix_array(data: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """Places in the order of their suffixes, as far as `depth` bytes tell; data: uint8, ends in 0, which is less than all.

    Two stages: the suffixes smaller than their successors (S) are sorted directly; the
    others (L) are induced, bucket by bucket: a place before one that is already in order
    goes to the end of what its own bucket has.
    """
    n = len(data)
    data = data.astype(np.int16)
    step = np.append(np.sign(data[1:] - data[:-1]), 1)
    known = np.where(step != 0, np.arange(n), n - 1)
    nearest = np.minimum.accumulate(known[::-1])[::-1]
    small = step[nearest] > 0  # S
    padded = np.append(data, np.zeros(depth, np.int16)).astype(np.uint8)
    starts = np.flatnonzero(small)
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[starts]).view(f"S{depth}").ravel()
    starts = starts[np.argsort(rows, kind="stable")]
    of_bucket = data[starts]
    bounds = np.searchsorted(of_bucket, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def induce(places: np.ndarray, bucket: int) -> np.ndarray:
        """Hand the larger places before these to their buckets; those of the same bucket are returned."""
        before = places[places > 0] - 1
        before = before[~small[before]]
        letters = data[before]
        own = before[letters == bucket]
        rest, letters = before[letters > bucket], letters[letters > bucket]
        if not len(rest):
            return own
        order = np.argsort(letters, kind="stable")
        rest, letters = rest[order], letters[order]
        cuts = np.flatnonzero(np.append(True, letters[1:] != letters[:-1])).tolist()
        for i, j in zip(cuts, [*cuts[1:], len(rest)], strict=True):
            induced[int(letters[i])].append(rest[i:j])
        return own

    for bucket in range(256):
        queue = np.concatenate(induced[bucket]) if induced[bucket] else np.zeros(0, np.int64)
        while len(queue):  # once for each further letter of a run
            out.append(queue)
            queue = induce(queue, bucket)
        sorted_small = starts[bounds[bucket] : bounds[bucket + 1]]
        if len(sorted_small):
            out.append(sorted_small)
            induce(sorted_small, bucket)
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, places: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """The common prefix of each suffix and the one before it, up to depth; 0 for the first."""
    windows = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(depth, np.uint8)), depth)
    out = np.zeros(len(places), np.int64)
    for low in range(1, len(places), 1 << 16):
        own = slice(low, min(len(places), low + (1 << 16)))
        apart = windows[places[own]] != windows[places[own.start - 1 : own.stop - 1]]
        out[own] = np.where(apart.any(1), apart.argmax(1), depth)
    return out


def repeated_windows(texts: list[bytes], order: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(text, offset) of each window that an earlier text (by order) also has.  No text has a window twice, nor bytes 0xFF (UTF-8 has none)."""
    lengths = np.array([len(t) + 1 for t in texts])
    joined = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8) + np.uint8(1)  # the separators become 0
    base = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(texts)), lengths)
    offset = np.arange(len(joined)) - base[text]
    window = offset + span < lengths[text]
    places = suffix_array(joined, span)
    places = places[window[places]]
    group = np.cumsum(common_prefixes(joined, places, span) < span)
    rank = order[text[places]]
    least = np.full(int(group[-1]) + 1 if len(group) else 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, rank)
    again = places[rank > least[group]]
    return text[again], offset[again]


def _anchored(rows: DataFrame, gram: int) -> DataFrame:
    """rows: id, v, text, perhaps base.  anchor, content, id, v, at (of the first window, in the whole text), n, and base."""
    based = "base" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in runs(batch.column(2), 2 << 20):
                part = batch.slice(low, high - low)
                texts = [x or b"" for x in part.column(2).cast(pa.binary()).to_pylist()]
                begin = part.column(3).to_numpy() if based else np.zeros(len(texts), np.int64)
                found = []
                for k, text in enumerate(texts):
                    if len(text) >= SPAN:
                        for base, piece in pieces(np.frombuffer(text, np.uint8)):
                            anchor, content, first, n = segments(piece, SPAN, gram)
                            found.append((anchor, content, np.full(len(n), k), begin[k] + base + first, n))
                if found:
                    anchor, content, k, at, n = (np.concatenate(x) for x in zip(*found, strict=True))
                    of = pa.array(k)
                    columns = [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), part.column(0).take(of), part.column(1).take(of), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))]
                    names = ["anchor", "content", "id", "v", "at", "n"]
                    yield pa.RecordBatch.from_arrays([*columns, part.column(3).take(of)] if based else columns, [*names, "base"] if based else names)

    return rows.select("id", "v", "text", *(["base"] if based else [])).mapInArrow(run, "anchor long, content long, id long, v long, at int, n int" + (", base int" if based else ""))


def _by_suffixes(sides: DataFrame) -> DataFrame:
    """sides: anchor, id, v, at, seg.  id, v, at (of the window): windows that an earlier segment of the same anchor has."""

    def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        anchors = rows.column("anchor").to_numpy()
        ids, marks, at = (rows.column(c).to_numpy() for c in ("id", "v", "at"))
        segs = rows.column("seg").to_pylist()
        begin = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1])).tolist()
        low, held = 0, 0
        for i, j in zip(begin, [*begin[1:], len(segs)], strict=True):
            held += sum(map(len, segs[i:j]))
            if held >= BLOCK or j == len(segs):
                own = slice(low, j)
                # Ranks by id, mark and place; equal ones (rows alike) are one occurrence.
                place = np.stack([ids[own], marks[own], at[own].astype(np.int64)])
                by = np.lexsort(place[::-1])
                order = np.empty(j - low, np.int64)
                order[by] = np.cumsum(np.append(0, (place[:, by[1:]] != place[:, by[:-1]]).any(0)))
                text, offset = repeated_windows(segs[low:j], order)
                yield pa.RecordBatch.from_arrays([pa.array(ids[own][text]), pa.array(marks[own][text]), pa.array((at[own][text] + offset).astype(np.int32))], ["id", "v", "at"])
                low, held = j, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            anchors = rows.column("anchor").to_numpy()
            other = np.flatnonzero(anchors != anchors[-1])
            if len(other):
                done = int(other[-1]) + 1
                yield from flush(rows.slice(0, done))
                held = rows.slice(done).combine_chunks().to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held))

    n = partitions(sides.sparkSession)
    own = sides.select("anchor", "id", "v", "at", "seg").repartition(n, "anchor").sortWithinPartitions("anchor")
    return own.mapInArrow(run, "id long, v long, at int")


def repeats(docs: DataFrame) -> DataFrame:
    """docs: id (long, no null), v (long: tells texts of one id apart), text.  id, v, at (of the first window), n: runs of windows that also start earlier."""
    found, rows = None, docs
    for level, gram in enumerate(GRAMS):
        copied, single, crowded = _level(rows, gram)
        both = copied.unionByName(single.withColumn("n", F.lit(1)))
        found = both if found is None else found.unionByName(both)
        if level + 1 == len(GRAMS) or crowded.isEmpty():
            return found
        # A class stands for its copies, which are removed whole: what is left are its first segments.
        rows = crowded.select("id", "v", F.col("at").alias("base"), F.col("seg").alias("text"))
    return found


def _level(rows: DataFrame, gram: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows: id, v, text, of stretches of texts also base, where they begin.  Runs that are copies, single windows that are, and the segments (with `seg`) of crowded anchors."""
    spark = rows.sparkSession
    of = ["id", "v", *(["base"] if "base" in rows.columns else [])]
    keys = ["id", "v", "at", *of[2:]]
    own = _anchored(rows, gram)
    often = written(own.groupBy("anchor").agg(F.count("*").alias("rows")).where("rows > 1"))
    release(spark)
    total = often.agg(F.sum("rows")).head()[0] or 0
    held = written(join_dealt(own, often, ["anchor"], count="rows", total=total, by=keys).drop("rows"))
    discard(often)
    release(spark)
    place = F.struct(*keys)
    classes = written(held.groupBy("anchor", "content").agg(F.min(place).alias("first"), F.count("*").alias("copies"), F.max("n").alias("n")))
    release(spark)
    again = classes.where("copies > 1").select("anchor", "content", "first", "copies")
    copied = join_dealt(held, again, ["anchor", "content"], count="copies", total=total, by=keys).where(place != F.col("first")).select("id", "v", "at", "n")
    sharing = written(classes.groupBy("anchor").agg(F.count("*").alias("classes")).where("classes > 1"))
    parted = classes.select("anchor", *[F.col(f"first.{k}").alias(k) for k in keys], "n")
    shared = join_dealt(parted, sharing, ["anchor"], count="classes", total=classes.count(), by=keys)
    met = rows.join(shared, of)
    begin = F.col("at") - F.col("base") if "base" in of else F.col("at")
    segs = written(met.select("anchor", "classes", "id", "v", "at", "n", F.substring(F.col("text").cast("binary"), begin + 1, F.col("n") + (SPAN - 1)).alias("seg")))
    discard(sharing)
    release(spark)
    return copied, _by_suffixes(segs.where(F.col("classes") <= MANY)), segs.where(F.col("classes") > MANY)


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (nulls: LEAST), v, text.  v: a hash of the text where texts of one id differ, else 0, so that it costs nothing."""
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("id"), text_key(text_col).alias("v"), text_of(text_col).alias("text"))
    shared = written(own.groupBy("id").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low <> high").select("id", F.lit(True).alias("differ")))
    if shared.isEmpty():
        discard(shared)
        return own.withColumn("v", F.lit(0).cast("long"))
    return own.join(shared, "id", "left").select("id", F.when(F.col("differ"), F.col("v")).otherwise(F.lit(0).cast("long")).alias("v"), "text")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, kept (binary), spans (array of start, end in bytes: the maximal removed runs); one row for each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    own = _marked(docs, id_col, text_col)
    found = repeats(own).groupBy("id", "v").agg(F.collect_list(F.struct(F.col("at").alias("s"), "n")).alias("runs"))
    joined = own.join(found, ["id", "v"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in runs(batch.column(1), 8 << 20):
                part = batch.slice(low, high - low)
                lists = part.column(2)
                flat = lists.flatten()
                starts, counts = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                bounds = np.append(0, np.cumsum(sizes)).tolist()
                kept, spans, lengths = [], [], []
                for k, text in enumerate(part.column(1).cast(pa.binary()).to_pylist()):
                    lengths.append(len(text))
                    own = slice(bounds[k], bounds[k + 1])
                    merged = cover(starts[own], counts[own])
                    spans.append([{"start": int(a), "end": int(b)} for a, b in merged])
                    at, left = 0, []
                    for a, b in merged:
                        left.append(text[at:a])
                        at = int(b)
                    left.append(text[at:])
                    kept.append(b"".join(left))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["id", "n_bytes", "kept", "spans"])

    out = joined.select("id", "text", "runs").mapInArrow(run, "id long, n_bytes long, kept binary, spans array<struct<start:bigint,end:bigint>>")
    return out.select(F.when(F.col("id") != LEAST, F.col("id")).cast(kind).alias(id_col), "n_bytes", "kept", "spans")


def cover(starts: np.ndarray, counts: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Maximal runs of the bytes that runs of windows cover: start, end."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(starts, kind="stable")
    begin = starts[order].astype(np.int64)
    end = np.maximum.accumulate(begin + counts[order] + span - 1)
    fresh = np.append(True, begin[1:] > end[:-1])
    return np.stack([begin[fresh], end[np.append(fresh[1:], True)]], 1)
