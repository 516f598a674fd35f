"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are a text's words (runs of letters, lowered) and their prefixes of PREFIX
letters.  The examples are a bounded sample of labelled rows (EXAMPLES, those of
least id hash).  Every term of theirs that tells the examples' classes apart better
than chance (a z score over CHANCE, for either class; no limit to their number) is a
dimension.  A vector has log(1 + count) * idf * relevance: idf from the document
frequencies over all documents; relevance grows with the z score from 0 at CHANCE to 1
at CERTAIN.  One more dimension, which all texts share, is for all other words (log(2 +
how many)), so that the cosine knows how much of a text the telling ones are.  Plain
TF-IDF (relevance 1 for all terms) finds neighbours by topic, and a small relevance for
the others costs more time than there is: see the README's figures.

The examples stand in an inverted index: for each term the examples that have it
and their weights, in blocks of BLOCK examples, with the largest weight of each
block.  A text's cosine with any example of a block is at most the sum over its
terms of weight times block maximum; the blocks of the largest bounds are scored
first, then all whose bound is not below the NEIGHBOURS-th best cosine so far.  The
neighbours are therefore exact.

A score is the neighbours' share of toxic labels, weighted by 1 / (distance +
SOFT), then calibrated: a monotone map fitted on all examples, each without itself.
The evidence is the ids of the nearest toxic examples.

Null and empty texts have the shared dimension alone.  Ties in
cosine go to the smaller id.  Labels of rows that are not in docs are no examples; of
several labels of an id the largest counts, of several texts the one of least hash.
Without examples the score is 0.5 for all.  Rows alike have equal results, one for
each row; an empty table gives an empty one.  Texts of any length count whole.  Only
the named columns are read, so others may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, text_key, text_of, written
from .minhash import runs

EXAMPLES = 3000
PREFIX = 4
CHANCE, CERTAIN = 3.0, 13.0
NEIGHBOURS = 24
BLOCK = 64
SOFT = 0.03
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def terms_of(word: str) -> list[int]:
    """Hashes of a word's terms."""
    own = [xxhash.xxh64_intdigest(word, 1)]
    return [*own, xxhash.xxh64_intdigest(word[:PREFIX], 2)] if len(word) >= PREFIX else own


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's terms and how often each occurs."""
    found: Counter = Counter()
    for word, n in Counter(WORD.findall(text.lower())).items():
        for t in terms_of(word):
            found[t] += n
    terms = np.fromiter(found.keys(), np.uint64, len(found))
    order = np.argsort(terms)
    return terms[order], np.fromiter(found.values(), np.int64, len(found))[order]


class Vocabulary:
    """The telling terms (ascending hashes); words are looked up once."""

    def __init__(self, terms: np.ndarray) -> None:
        self.terms = terms
        self.place: dict[int, int] | None = None
        self.known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "place": None, "known": {}}

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Places of the text's terms, ascending, how often each occurs (other terms are left out), and how many words have none."""
        if self.place is None:
            self.place = dict(zip(self.terms.tolist(), range(len(self.terms)), strict=True))
        found: Counter = Counter()
        other = 0
        for word, n in Counter(WORD.findall(text.lower())).items():
            own = self.known.get(word)
            if own is None:
                own = tuple(self.place[t] for t in terms_of(word) if t in self.place)
                if len(self.known) > 100_000:
                    self.known.clear()
                self.known[word] = own
            for t in own:
                found[t] += n
            other += 0 if own else n
        places = np.fromiter(found.keys(), np.int64, len(found))
        order = np.argsort(places)
        return places[order], np.fromiter(found.values(), np.int64, len(found))[order], other


def unit(places: np.ndarray, n: np.ndarray, other: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and values of a vector of length 1; the shared dimension is the one after the terms'."""
    values = np.append(np.log1p(n) * weights[places], np.log(2 + other))
    return np.append(places, len(weights)), values / np.sqrt((values**2).sum())


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + size[0] - 1, first[1] .."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Index:
    """Postings of the examples (ids ascending), in blocks, with each block's largest weight."""

    def __init__(self, places: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, ids: list, terms: int, block: int = BLOCK) -> None:
        self.labels, self.ids, self.block = labels, ids, block
        self.blocks = -(-len(ids) // block)
        size = np.array([len(p) for p in places], np.int64)
        term, weight = np.concatenate(places), np.concatenate(values)
        # Alike examples are put side by side, so that a block's maxima are near its members: by the heaviest term.
        heaviest = np.array([p[np.argmax(v)] if len(p) else -1 for p, v in zip(places, values, strict=True)])
        self.order = np.argsort(heaviest, kind="stable")  # slot -> example
        slot = np.empty(len(ids), np.int64)
        slot[self.order] = np.arange(len(ids))
        at = np.repeat(slot, size)
        by = np.lexsort((at, term))
        term, at, weight = term[by], at[by], weight[by]
        fresh = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (at[1:] // block != at[:-1] // block))) if len(term) else np.zeros(0, np.int64)
        self.at, self.weight = at.astype(np.int32), weight.astype(np.float64)
        self.begin = np.append(fresh, len(term))  # of an entry (a term's postings in a block) in the postings
        self.of = (at[fresh] // block).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, fresh) if len(fresh) else np.zeros(0)
        self.first = np.searchsorted(term[fresh], np.arange(terms + 1))  # of a term in the entries

    def nearest(self, places: np.ndarray, values: np.ndarray, k: int = NEIGHBOURS, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine (ties: the smaller id) and the cosines; without: an example left out."""
        size = self.first[places + 1] - self.first[places]
        entry, value = _ranges(self.first[places], size), np.repeat(values, size)
        of = self.of[entry]
        bound = np.bincount(of, value * self.most[entry], self.blocks)
        by = np.argsort(-bound, kind="stable")
        few = max(4, -(-2 * k // self.block))
        cosine, seen = np.zeros(len(self.ids)), np.zeros(self.blocks, bool)

        def visit(blocks: np.ndarray) -> None:
            wanted = np.zeros(self.blocks, bool)
            wanted[blocks] = True
            own = wanted[of]
            e, v = entry[own], value[own]
            n = self.begin[e + 1] - self.begin[e]
            posting = _ranges(self.begin[e], n)
            cosine[:] += np.bincount(self.at[posting], np.repeat(v, n) * self.weight[posting], len(self.ids))
            seen[blocks] = True

        def best() -> tuple[np.ndarray, np.ndarray]:
            slots = np.flatnonzero(np.repeat(seen, self.block)[: len(self.ids)])
            found = self.order[slots]
            if without is not None:
                slots, found = slots[found != without], found[found != without]
            top = np.lexsort((found, -cosine[slots].round(12)))[:k]
            return found[top], cosine[slots[top]]

        visit(by[:few])
        near, close = best()
        least = close[-1] if len(near) == k else -1.0
        rest = by[few:][bound[by[few:]] >= least - 1e-9]
        if len(rest):
            visit(rest)
            near, close = best()
        return near, close

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        weight = 1 / (np.maximum(0, 1 - cosine) + SOFT)
        return float((weight * self.labels[near]).sum() / weight.sum()) if len(near) else 0.5


def monotone(raw: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the increasing map that fits labels best (pool adjacent violators), as points to interpolate."""
    order = np.argsort(raw, kind="stable")
    groups: list[list[float]] = []
    for x, y in zip(raw[order], labels[order], strict=True):
        groups.append([float(y), 1.0, float(x)])
        while len(groups) > 1 and groups[-2][0] / groups[-2][1] >= groups[-1][0] / groups[-1][1]:
            y1, n1, x1 = groups.pop()
            groups[-1] = [groups[-1][0] + y1, groups[-1][1] + n1, (groups[-1][2] * groups[-1][1] + x1 * n1) / (groups[-1][1] + n1)]
    return np.array([g[2] for g in groups]), np.array([(g[0] + 0.5) / (g[1] + 1) for g in groups])


class Model:
    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray, index: Index | None, steps: tuple[np.ndarray, np.ndarray]) -> None:
        self.vocabulary, self.weights, self.index, self.steps = vocabulary, weights, index, steps
        self.scored: dict[bytes, tuple[float, list]] = {}

    def score(self, text: str) -> tuple[float, list]:
        if self.index is None:
            return 0.5, []
        places, n, other = self.vocabulary.counts(text)
        key = xxhash.xxh3_128_digest(places.tobytes() + n.tobytes() + str(other).encode())
        if (found := self.scored.get(key)) is None:
            near, cosine = self.index.nearest(*unit(places, n, other, self.weights))
            raw = self.index.vote(near, cosine)
            found = float(np.clip(np.interp(raw, *self.steps), 0, 1)), [self.index.ids[x] for x in near[self.index.labels[near] == 1][:3]]
            if len(self.scored) > 20_000:
                self.scored.clear()
            self.scored[key] = found
        return found


def scores(with_toxic: np.ndarray, with_clean: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """The z score of each term, from how many examples of either class have it, by a test of equal shares."""
    share = (with_toxic + with_clean) / max(1, toxic + clean)
    spread = np.sqrt(share * (1 - share) * (1 / max(1, toxic) + 1 / max(1, clean)))
    return np.abs(with_toxic / max(1, toxic) - with_clean / max(1, clean)) / np.maximum(spread, 1e-9)


def _frequencies(docs: DataFrame, text_col: str, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """In how many documents each term is, and how many documents there are; counted in the tasks, summed by Spark."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the examples' terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        total, n = np.zeros(len(own.terms), np.int64), 0
        for batch in batches:
            for low, high in runs(batch.column(0), 8 << 20):
                texts = batch.column(0).slice(low, high - low).to_pylist()
                held = [own.counts(x or "")[0] for x in texts]
                total += np.bincount(np.concatenate(held), minlength=len(total))
                n += len(texts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["term", "n"])

    summed = docs.select(text_col).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = summed.column("term").to_numpy(), summed.column("n").to_numpy()
    out = np.zeros(len(vocabulary.terms) + 1, np.int64)
    out[term] = n  # the last one, -1, is the number of documents
    return out[:-1], int(out[-1])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", where: Column | None = None, examples: int = EXAMPLES) -> Model:
    """A model of at most `examples` labelled rows (those of least hash; `where` holds for them)."""
    given = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    given = given if where is None else given.where(where)
    chosen = written(given.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(examples))
    texts = docs.select(F.col(id_col).alias("_doc"), text_of(text_col).alias("_text"), text_key(text_col).alias("_key"))
    sample = texts.join(F.broadcast(chosen), texts["_doc"] == chosen["_id"])  # at most `examples` ids are broadcast
    sample = written(sample.groupBy("_id", "_label").agg(F.min_by("_text", "_key").alias("_text")))
    kind = docs.schema[id_col].dataType.simpleString()

    def termed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in runs(batch.column(2), 8 << 20):
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([counts(t)[0].tobytes() for t in part.column(2).to_pylist()], pa.binary())], ["id", "label", "terms"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in runs(batch.column(1), 8 << 20):
                part = batch.slice(low, high - low)
                found = [vocabulary.counts(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([p.tobytes() for p, _, _ in found], pa.binary()), pa.array([n.tobytes() for _, n, _ in found], pa.binary()), pa.array([o for _, _, o in found], pa.int64())], ["id", "places", "n", "other"])

    held = sample.select("_id", "_label", "_text").mapInArrow(termed, f"id {kind}, label int, terms binary").toArrow()
    discard(chosen)
    if not len(held):
        return Model(Vocabulary(np.zeros(0, np.uint64)), np.zeros(0), None, (np.zeros(1), np.full(1, 0.5)))
    rows = sorted(zip(*(held.column(c).to_pylist() for c in ("id", "label", "terms")), strict=True), key=lambda r: r[0])
    toxic = np.array([r[1] > 0 for r in rows])
    terms = [np.frombuffer(r[2], np.uint64) for r in rows]
    every = np.unique(np.concatenate(terms))
    with_term = [np.zeros(len(every), np.int64) for _ in range(2)]
    for t, side in zip(terms, toxic.tolist(), strict=True):
        with_term[side][np.searchsorted(every, t)] += 1
    z = scores(with_term[1], with_term[0], int(toxic.sum()), int((~toxic).sum()))
    every, z = every[z > CHANCE], z[z > CHANCE]
    vocabulary = Vocabulary(every)
    frequency, n = _frequencies(docs, text_col, vocabulary)
    weights = (1 + np.log((n + 1) / (frequency + 1))) * np.minimum((z - CHANCE) / (CERTAIN - CHANCE), 1)
    held = sample.select("_id", "_text").mapInArrow(counted, f"id {kind}, places binary, n binary, other long").toArrow()
    discard(sample)
    found = sorted(zip(*(held.column(c).to_pylist() for c in ("id", "places", "n", "other")), strict=True), key=lambda r: r[0])
    vectors = [unit(np.frombuffer(p, np.int64), np.frombuffer(c, np.int64), o, weights) for _, p, c, o in found]
    index = Index([p for p, _ in vectors], [v for _, v in vectors], toxic.astype(int), [r[0] for r in rows], len(every) + 1)
    raw = [index.vote(*index.nearest(p, v, without=i)) for i, (p, v) in enumerate(vectors)]
    return Model(vocabulary, weights, index, monotone(np.array(raw), index.labels))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score (0 to 1), evidence (ids of up to three of the nearest toxic examples); one row for each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the examples' terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for low, high in runs(batch.column(1), 8 << 20):
                part = batch.slice(low, high - low)
                found = [own.score(x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.list_(part.column(0).type))], [id_col, "score", "evidence"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, score double, evidence array<{kind}>")
