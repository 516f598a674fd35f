import random
from zlib import crc32

import numpy as np

from tidemark.llm import toxicity

from .helpers import WORDS, documents


def vectors(rng, n, terms, share):
    out = []
    for _ in range(n):
        places = np.flatnonzero(rng.random(terms) < share)
        values = rng.random(len(places)) + 0.01
        out.append((places, values / (np.linalg.norm(values) or 1)))
    return out


def test_neighbours_are_exact():
    rng = np.random.default_rng(1)
    held = vectors(rng, 300, 60, 0.2)
    held[7] = held[200] = held[3]  # ties
    index = toxicity.Index([p for p, _ in held], [v for _, v in held], rng.integers(0, 2, 300), list(range(300)), 60, block=16)
    matrix = np.zeros((300, 60))
    for i, (p, v) in enumerate(held):
        matrix[i, p] = v
    for k, (p, v) in enumerate([*vectors(rng, 50, 60, 0.3), held[3], (np.zeros(0, np.int64), np.zeros(0))]):
        without = 5 if k % 2 else None
        query = np.zeros(60)
        query[p] = v
        cosine = matrix @ query
        want = [i for i in sorted(range(300), key=lambda i: (-round(cosine[i], 12), i)) if i != without][:7]
        near, close = index.nearest(p, v, 7, without)
        assert near.tolist() == want and np.allclose(close, cosine[want], atol=1e-9)


def test_monotone():
    x, y = toxicity.monotone(np.array([0.1, 0.2, 0.3, 0.9, 0.8]), np.array([0, 1, 0, 1, 1]))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and y[0] < 0.5 < y[-1]


def corpus():
    rng = random.Random(2)
    items, toxic = [None, ""], [0, 0]
    for i in range(400):
        words = rng.choices(WORDS, k=rng.randint(5, 60))
        toxic.append(int(i % 5 == 0))
        if toxic[-1]:
            for _ in range(2 + len(words) // 12):
                words.insert(rng.randrange(len(words)), rng.choice(["Blorg,", "snarfish", "vexxed"]))
        items.append(" ".join(words))
    return items, toxic


def test_held_out_accuracy(spark):
    items, toxic = corpus()
    docs = documents(spark, items).withColumnRenamed("lang", "score")
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(3, 1, None), (None, 1, 1), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, where=~toxicity.held_out())
    rows = toxicity.score(docs, model).withColumn("held", toxicity.held_out()).collect()
    assert len(rows) == len(items)
    assert all(r.held == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held]
    assert np.mean([(r.score >= toxicity.THRESHOLD) == bool(toxic[r.doc_id]) for r in held]) > 0.95
    assert all(toxic[e] for r in rows for e in r.evidence)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_no_labels(spark):
    docs = documents(spark, ["a b", None])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert [r.score for r in toxicity.score(docs, model).collect()] == [0.5, 0.5]


def test_against_brute_force(spark):
    """Every score from dictionaries: terms, document frequencies, relevance, all cosines, the vote, the calibrated map."""
    items, toxic = corpus()
    items, toxic = items[:160], toxic[:160]
    docs = documents(spark, items)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")

    def terms(text):
        out = {}
        for w in toxicity.WORD.findall((text or "").lower()):
            for t in [w] + ([w[:4] + "*"] if len(w) >= 4 else []):
                out[t] = out.get(t, 0) + 1
        return out

    train = [i for i in range(len(items)) if crc32(str(i).encode()) % 3 != 1]
    every = [terms(t) for t in items]
    known = {t for i in train for t in every[i]}
    n1 = sum(toxic[i] for i in train)
    n0, weight, telling = len(train) - n1, {}, set()
    for t in known:
        a, b = (sum(t in every[i] for i in train if toxic[i] == side) for side in (1, 0))
        share = (a + b) / len(train)
        z = abs(a / n1 - b / n0) / max((share * (1 - share) * (1 / n1 + 1 / n0)) ** 0.5, 1e-9)
        weight[t] = (1 + np.log((len(items) + 1) / (sum(t in e for e in every) + 1))) * min(max((z - 3) / 10, 0), 1)
        telling |= {t} if z > 3 else set()

    def vector(i):
        words = toxicity.WORD.findall((items[i] or "").lower())
        held = {t: np.log1p(n) * weight[t] for t, n in every[i].items() if t in telling}
        held["shared"] = np.log(2 + sum(w not in telling and w[:4] + "*" not in telling for w in words))
        norm = sum(x * x for x in held.values()) ** 0.5
        return {t: x / norm for t, x in held.items()}

    space = {i: vector(i) for i in train}

    def raw(own, without=None):
        cosine = {i: sum(x * v.get(t, 0) for t, x in own.items()) for i, v in space.items() if i != without}
        near = sorted(cosine, key=lambda i: (-round(cosine[i], 12), i))[: toxicity.NEIGHBOURS]
        each = [(1 / (max(0, 1 - cosine[i]) + toxicity.SOFT), toxic[i]) for i in near]
        return sum(w * t for w, t in each) / sum(w for w, _ in each)

    steps = toxicity.monotone(np.array([raw(space[i], i) for i in train]), np.array([toxic[i] for i in train]))
    model = toxicity.fit(docs, labels, where=~toxicity.held_out())
    for r in toxicity.score(docs, model).collect():
        assert abs(r.score - np.clip(np.interp(raw(vector(r.doc_id)), *steps), 0, 1)) < 1e-6, r.doc_id


def test_ids_of_any_kind_and_repeated_rows(spark):
    rows = [(f"d{i}", "vexxed blorg talk" if i % 2 else "the cat sat here", i) for i in range(40)] + [("d1", "other text of d1", 0), ("d1", "vexxed blorg talk", 0)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, evidence int")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(40)], "doc_id string, toxic int")
    found = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(found) == len(rows) and all(isinstance(e, str) for r in found for e in r.evidence)
