import numpy as np

from tidemark.llm import quality

from .helpers import documents

GOOD = "The cat sat near the door. It was a warm day, and nobody came by until dusk. Then the rain began again."
JUNK = ["one** two## three%% four&& five$$ " * 20, "BUY!! NOW!! AND!! HERE!! TODAY!! " * 20, "a | b | c | d | e | f | " * 20, "same same same same same same " * 30]


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(0)
    n = 20000
    good = rng.random(n) < 0.7
    knows = [0.95, 0.6, 0.3]  # how much of the junk each labeller finds; it votes junk on one good text of a thousand
    given = np.array([np.where(rng.random(n) < np.where(good, 0.001, k), -1, 1) for k in knows]).T
    patterns, counts = np.unique(given, axis=0, return_counts=True)
    posterior, found, share = quality.expectation_maximisation(patterns, counts)
    assert abs(share - 0.7) < 0.03
    assert (np.abs(found[:, 1] - knows) < 0.05).all() and (found[:, 0] > 0.99).all()
    assert posterior[(patterns == 1).all(1)] > 0.9 and posterior[(patterns == -1).all(1)] < 0.1


def test_junk_is_rejected(spark):
    items = [None, "", "  "] + [f"{GOOD} {GOOD[i:]} word{i}." for i in range(60)] + [f"{j} {i}" for i in range(8) for j in JUNK]
    docs = documents(spark, items).withColumnRenamed("lang", "score")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(3, 63)) <= ids
    assert not ids & set(range(63, len(items)))
    again = {r.doc_id for r in quality.keep_good(docs.repartition(7)).collect()}
    assert ids == again
    assert quality.keep_good(docs.limit(0)).count() == 0


def test_figures_of_odd_texts():
    for text in (b"", b"\n", b"a", b"\xff\xfe", b"x" * 100000, "中文".encode() * 1000):
        row = quality.figures(text)
        assert len(row) == len(quality.LABELLERS) and all(0 <= x for x in row)
        assert np.isfinite(quality.features(text, row)).all()


def test_against_brute_force(spark):
    """Votes counted, estimated, learnt and applied by plain Python, one document at a time."""
    items = [None, ""] + [f"{GOOD} {GOOD[i:]} word{i}." for i in range(40)] + [f"{j} {i}" for i in range(6) for j in JUNK] + [GOOD, GOOD]
    texts = [(t or "").encode() for t in items]
    votes = []
    for t in texts:
        row = quality.figures(t)
        votes.append([0 if not any(row) else -1 if x >= junk else 1 if x <= good else 0 for x, (_, junk, good) in zip(row, quality.LABELLERS, strict=True)])
    # EM over the documents, not over counted patterns.
    good, share = [1 / (1 + np.exp(-(2.0 - 4.0 * v.count(-1)))) for v in votes], 0.5
    prior = {True: (0.02, 0.5, 2.0), False: (1.0, 1.0, 1.0)}
    for _ in range(quality.ROUNDS):
        tell = {}
        for side in (True, False):
            for k in range(len(quality.LABELLERS)):
                held = [p + sum(g if side else 1 - g for g, v in zip(good, votes, strict=True) if v[k] == w) for w, p in zip((-1, 0, 1), prior[side], strict=True)]
                tell[side, k] = [x / sum(held) for x in held]
                if side:
                    tell[side, k][0] = min(tell[side, k][0], quality.FALSE_JUNK)
        share = min(0.999, max(0.001, sum(good) / len(good)))
        odds = [np.log(share / (1 - share)) + sum(np.log(tell[True, k][w + 1] / tell[False, k][w + 1]) for k, w in enumerate(v)) for v in votes]
        good = [1 / (1 + np.exp(-np.clip(o, -50, 50))) for o in odds]
    docs = documents(spark, items)
    weights, told = quality.fit(docs)
    assert abs(told["share"] - share) < 1e-6
    for k, (name, _, _) in enumerate(quality.LABELLERS):
        a, b = tell[True, k], tell[False, k]
        assert np.allclose(told["accuracy"][name], [a[2] / (a[2] + a[0]), b[0] / (b[0] + b[2])], atol=1e-6)
    # The scorer: logistic regression by the same steps in double precision, features by a dictionary.
    x = []
    for t in texts:
        grams = {}
        for i in range(len(t) - 2):
            code = (t[i] * 0x9E3779B1 + t[i + 1] * 0x85EBCA6B + t[i + 2] * 0xC2B2AE35) % 2**32 >> 20
            grams[code] = grams.get(code, 0) + 1
        norm = sum(grams.values()) ** 0.5
        row = np.zeros(quality.GRAMS + len(quality.LABELLERS) * quality.RANGES + 1)
        for c, n in grams.items():
            row[c] = n**0.5 / norm
        for k, (f, (_, junk, fine)) in enumerate(zip(quality.figures(t), quality.LABELLERS, strict=True)):
            low, high = min(junk, fine), max(junk, fine)
            row[quality.GRAMS + k * quality.RANGES + int(min(max(4 + 8 * (f - low) / (high - low), 0), quality.RANGES - 1))] = 1
        row[-1] = 1
        x.append(row)
    x, y, w = np.array(x), np.array(good), np.zeros(len(x[0]))
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for t in range(1, 251):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y) / len(x) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    want = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    got = {r.doc_id: r.score for r in quality.score(docs, weights, score_col="score").collect()}
    assert max(abs(got[i] - p) for i, p in enumerate(want)) < 0.02
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert kept == {i for i, p in enumerate(want) if p >= quality.KEEP}


def test_clashing_names_and_repeated_rows(spark):
    rows = [(i, GOOD if i % 2 else JUNK[i % 4], "e", float(i), "x") for i in range(12)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, pattern string, _score double, y string")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r["_score"]) for r in kept.collect()) == sorted((i, float(i)) for i in range(1, 12, 2) for _ in range(2))
