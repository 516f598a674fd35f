import random

import numpy as np

from tidemark.llm import minhash

from .helpers import documents, texts


def shingles(text, k=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_likeness_estimates_jaccard():
    a = " ".join(f"w{i}" for i in range(400))
    for changed in (0, 5, 40, 400):
        b = " ".join(f"v{i}" if i % 400 < changed else f"w{i}" for i in range(400))
        x, y = shingles(a), shingles(b)
        sig = minhash.signatures([a.encode(), b.encode()])
        assert abs((sig[0] == sig[1]).mean() - len(x & y) / len(x | y)) < 0.13


def test_hashes_follow_words():
    (one, n), (two, m) = minhash.shingle_hashes([b"A b\tc d e f", b"", b"a"]), minhash.shingle_hashes([b"a B c  d e f\n", b" ", b"A"])
    assert n.tolist() == m.tolist() == [2, 0, 1] and one.tolist() == two.tolist()


def test_edits_in_order(spark):
    items = texts()
    docs = documents(spark, items).repartition(5)
    rows = {r.doc_id: r for r in minhash.compare_edits(docs).collect()}
    assert sorted(rows) == list(range(len(items)))
    own = [t or "" for t in items]
    for i, t in enumerate(own):
        nxt = own[(i + 1) % len(own)]
        half = len(t) // 2
        r = rows[i]
        assert (r.n_chars, r.edited) == (len(t), t[: len(t) - half] + nxt[:half])
        sig = [np.frombuffer(x, "<u4") for x in (r.signature, r.edited_signature)]
        assert r.near_edited == (sig[0] == sig[1]).mean()
        assert r.near_next == (sig[0] == np.frombuffer(rows[(i + 1) % len(own)].signature, "<u4")).mean()
        assert sig[1].tolist() == minhash.signatures([r.edited.encode()])[0].tolist()


def test_one_none_repeated_and_null_ids(spark):
    schema = "doc_id long, text string, signature string"
    one = minhash.compare_edits(spark.createDataFrame([(7, "abcd", "x")], schema)).collect()
    assert [(r.doc_id, r.edited) for r in one] == [(7, "abab")]
    assert minhash.compare_edits(spark.createDataFrame([], schema)).count() == 0
    rows = minhash.compare_edits(spark.createDataFrame([(None, "aa", ""), (1, "bb", ""), (1, "bb", ""), (2, None, "")], schema)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.edited) for r in rows) == [(False, 0, "ab"), (True, 1, "b"), (True, 1, "bb"), (True, 2, "")]


def likeness(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def brute_clusters(items, similarity=0.8):
    """The smallest place in items of each one's component of links."""
    label = list(range(len(items)))
    for i in range(len(items)):
        for j in range(i):
            if label[i] != label[j] and likeness(items[i] or "", items[j] or "") >= similarity:
                x, y = sorted((label[i], label[j]))
                label = [x if k == y else k for k in label]
    return label


def clusters(docs, **options):
    return sorted(((r.id, r.cluster_id) for r in minhash.near_duplicates(docs, **options).collect()), key=str)


def template(rng, n, common, own):
    passage = [f"p{rng.randrange(50000)}" for _ in range(common)]
    return [" ".join(passage + [f"t{rng.randrange(10**6)}" for _ in range(rng.randint(*own))]) for _ in range(n)]


def test_near_duplicates(spark):
    items = texts(50)
    assert clusters(documents(spark, items)) == sorted(enumerate(brute_clusters(items)), key=str)


def test_groups_that_differ_from_their_centre(spark, monkeypatch):
    """Chains, and templates at 0.7 to 0.9: what the least member of a bucket does not settle is compared block by block."""
    rng = random.Random(21)
    chain = [[f"w{rng.randrange(50000)}" for _ in range(200)]]
    for _ in range(25):
        other = list(chain[-1])
        for p in rng.sample(range(0, 200, 6), 3):
            other[p] = f"e{rng.randrange(10**6)}"
        chain.append(other)
    items = [" ".join(w) for w in chain] + template(rng, 40, 300, (20, 70)) + template(rng, 20, 140, (10, 60)) + texts(30, 5)
    rng.shuffle(items)
    want = brute_clusters(items)
    assert len(set(want)) < len(set(items)) - 20
    for block in (1 << 17, 900):
        monkeypatch.setattr(minhash, "BLOCK", block)
        assert clusters(documents(spark, items)) == sorted(enumerate(want), key=str)


def test_recall_by_similarity(spark):
    """Pairs of 0.80 to 0.95: all must be found (a miss has a chance of 5e-5 at 0.8)."""
    rng = random.Random(22)
    base = [[f"w{rng.randrange(50000)}" for _ in range(rng.randint(250, 400))] for _ in range(300)]
    near = []
    for k, words in enumerate(base):
        other, goal = list(words), 0.80 + 0.15 * k / 300
        for p in rng.sample(range(5, len(words) - 5, 6), len(words) // 8):
            held = list(other)
            other[p] = f"e{rng.randrange(10**6)}"
            if likeness(" ".join(words), " ".join(other)) < goal:
                break
        near.append(" ".join(held))
    docs = documents(spark, [" ".join(w) for w in base] + near)
    assert dict(clusters(docs)) == {i: i % 300 for i in range(600)}


def test_ids_of_any_kind(spark):
    same, other = "one two three four five six", "another text of some six words"
    docs = spark.createDataFrame([("b", same, 1), ("a", same, 2), (None, other, 3), ("c", other, 4), ("c", same, 5), (None, None, 6), ("d", "", 7), ("d", "", 8)], "doc_id string, text string, node int")
    near = minhash.near_duplicates(docs)
    assert sorted(((r.id, r.cluster_id) for r in near.collect()), key=str) == sorted([("b", "a"), ("a", "a"), (None, "c"), ("c", "c"), ("c", "a"), (None, "d"), ("d", "d"), ("d", "d")], key=str)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    rows = minhash.compare_edits(docs, notes=near).collect()
    assert sorted([(r.doc_id, r.note) for r in rows], key=str) == sorted(((r.id, r.cluster_id) for r in near.collect()), key=str)


def test_notes_are_of_their_own_text(spark):
    docs = documents(spark, texts(40)).unionByName(documents(spark, texts(5, 9)))
    near = minhash.near_duplicates(docs)
    rows = minhash.compare_edits(docs, notes=near).collect()
    assert sorted([(r.doc_id, r.note) for r in rows], key=str) == sorted(((r.id, r.cluster_id) for r in near.collect()), key=str)


def test_what_is_settled_is_not_compared(spark, monkeypatch):
    """Sets of too different sizes meet no comparison, pairs that met alone only one; repeated rows change nothing."""
    rng = random.Random(23)
    base = [[f"w{rng.randrange(50000)}" for _ in range(300)] for _ in range(30)]
    items = [" ".join(w) for w in base] + [" ".join(w[:225]) for w in base] + [" ".join([*w[:255], *[f"e{rng.randrange(10**6)}" for _ in range(45)]]) for w in base[:10]]
    seen = {}
    stars, rest = minhash._stars, minhash._rest
    monkeypatch.setattr(minhash, "_stars", lambda pairs, sets, similarity: seen.update(pairs=pairs.count(), sets=sets.count(), nodes=sets.select("node").distinct().count()) or stars(pairs, sets, similarity))
    monkeypatch.setattr(minhash, "_rest", lambda members, sets, similarity: seen.update(rest=members.count()) or rest(members, sets, similarity))
    assert clusters(documents(spark, items[:60])) == [(i, i) for i in sorted(range(60), key=lambda i: str((i, i)))]
    assert seen["pairs"] == seen["rest"] == seen["sets"] == 0
    want = brute_clusters(items)
    docs = documents(spark, items)
    assert clusters(docs) == sorted(enumerate(want), key=str) and seen["sets"] > 0
    twice = docs.unionByName(docs).unionByName(docs)
    assert clusters(twice) == sorted([(i, c) for i, c in enumerate(want) for _ in range(3)], key=str) and seen["sets"] == seen["nodes"]
