import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import graph, minhash, simhash

from .helpers import documents, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text, k=4):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    label = {f: f for f in prints}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    own = sorted(label)
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {f: root(f) for f in own}


def test_fingerprints_and_components(spark):
    items = texts(120, 9) + ["a  b\tC d e", "A b c d\x0be", "a\xa0b c d e"]
    docs = documents(spark, items).withColumnRenamed("lang", "fingerprint")
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(items)
    prints = [brute_fingerprint(t) for t in items]
    assert {r.doc_id: r.fingerprint[0] & (2**64 - 1) for r in rows} == dict(enumerate(prints))
    component = brute_components(prints, 4)
    least = {}
    for i, f in enumerate(prints):
        least.setdefault(component[f], i)
    assert {r.doc_id: r.component_id for r in rows} == {i: least[component[f]] for i, f in enumerate(prints)}


def nodes_of(spark, prints):
    signed = [x - 2**64 if x >> 63 else x for x in sorted(prints)]
    return spark.createDataFrame([(x, [x]) for x in signed], "node long, fingerprint array<long>")


def test_links_find_every_component(spark):
    rng = random.Random(8)
    prints = set()
    for _ in range(30):
        seed = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 40])):
            x = seed
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            prints.add(x)
            if rng.random() < 0.2:
                seed = x
    want = brute_components(prints, 4)
    for block in (4, 1024):
        label = {r.node & (2**64 - 1): r.label for r in graph.components(simhash.links(nodes_of(spark, prints), block=block)).collect()}
        groups = {}
        for f, c in want.items():
            groups.setdefault(c, set()).add(f)
        got = {}
        for f in prints:
            got.setdefault(label.get(f, f if f < 2**63 else f - 2**64), set()).add(f)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_components_of_any_shape(spark):
    rng = random.Random(3)
    chains = [(i, i + 2) for i in range(0, 60)] + [(60, 61)]  # two chains that meet at the far end
    star = [(100 + i, 200) for i in range(50)] + [(100 + i, 200 + j) for i in range(10) for j in range(1, 20)]
    loose = [tuple(sorted(rng.sample(range(1000, 1400), 2))) for _ in range(200)]
    down = [(-i - 1, -i) for i in range(500, 540)]
    found = chains + star + loose + down
    rows = graph.components(spark.createDataFrame(sorted(set(found)), "a long, b long")).collect()
    label = {r.node: r.label for r in rows}
    assert len(label) == len(rows)
    root = {x: x for e in found for x in e}
    for _ in range(len(root)):
        was = dict(root)
        for a, b in found:
            root[a] = root[b] = min(root[a], root[b])
        if root == was:
            break
    assert {x: label.get(x, x) for x in root} == root
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_wider_fingerprints():
    rows = simhash.fingerprint_rows([b"a b c d e f g", b"", b"a b c d e f g"], 5, 3)
    assert rows.shape == (3, 3) and (rows[0] == rows[2]).all() and not rows[1].any() and len(set(rows[0].tolist())) == 3


def test_ids(spark):
    rows = [(None, "same text of some words"), (5, "same text of some words"), (None, "alone here by itself"), (5, "same text of some words"), (4, "quite another text with words")]
    docs = spark.createDataFrame([(*r, i % 2) for i, r in enumerate(rows)], "doc_id long, text string, node int")
    got = sorted(((r.doc_id or -1), r.component_id or -1) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, -1), (-1, 5), (4, 4), (5, 5), (5, 5)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id or -1), r.text) for r in kept.collect()) == [(-1, rows[2][1]), (4, rows[4][1]), (5, rows[1][1])]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_rows_alike_are_one(spark):
    rows = [(1, None, "x", 1), (1, "", "y", 2), (1, "", "a", 3), (None, "some text here of words", "b", 4), (None, "some text here of words", "b", 4), (2, "words of another sort here", "c", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, _id int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([rows[2], rows[4], rows[5]], key=str)


def test_keep_one_catches_light_edits(spark):
    rng = random.Random(6)
    base = [[f"w{rng.randrange(5000)}" for _ in range(300)] for _ in range(20)]
    edited = []
    for words in base:
        other = list(words)
        other[rng.randrange(300)] = "edit"
        edited.append(other)
    docs = documents(spark, [" ".join(w) for w in base + edited] + [" ".join(f"v{rng.randrange(5000)}" for _ in range(200)) for _ in range(20)])
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [*range(20), *range(40, 60)]


def test_bits_match_numpy():
    h = simhash.shingle_hashes(b"One two THREE four five", 4)
    assert [int(x) for x in h] == [xxhash.xxh64_intdigest(g, 42) for g in (b"one two three four", b"two three four five")]
    assert simhash.fingerprint_rows([b""], 4).tolist() == [[0]] and np.uint64(0) == simhash.fingerprint_rows([b" "], 4)[0, 0]


def shingles_of(text, k=5):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def likeness(a, b):
    x, y = shingles_of(a), shingles_of(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def edited_to(rng, words, similarity):
    """words with single words replaced, far apart, until the similarity is just above or below."""
    other, places = list(words), rng.sample(range(5, len(words) - 5, 6), len(words) // 8)
    for p in places:
        held = list(other)
        other[p] = f"e{rng.randrange(10**6)}"
        if likeness(" ".join(words), " ".join(other)) < similarity:
            return " ".join(held)
    raise AssertionError


def brute_kept(items):
    label = list(range(len(items)))
    for i in range(len(items)):
        for j in range(i):
            if label[i] != label[j] and likeness(items[i], items[j]) >= 0.8:
                x, y = sorted((label[i], label[j]))
                label = [x if k == y else k for k in label]
    return sorted(set(label))


def test_keep_one_finds_pairs_at_the_required_similarity(spark):
    rng = random.Random(12)
    base = [[f"w{rng.randrange(50000)}" for _ in range(rng.randint(250, 400))] for _ in range(100)]
    near = [edited_to(rng, w, 0.8 + 0.1 * (i % 10) / 10) for i, w in enumerate(base)]
    items = [" ".join(w) for w in base] + near + texts(60, 5)
    assert all(0.8 <= likeness(items[i], near[i]) < 0.95 for i in range(100))
    kept = sorted(r.doc_id for r in simhash.keep_one(documents(spark, items)).collect())
    assert kept == brute_kept(items) and not [i for i in kept if 100 <= i < 200]


def test_keep_one_keeps_what_is_less_alike(spark):
    rng = random.Random(13)
    passage = [f"p{rng.randrange(50000)}" for _ in range(300)]
    template = [" ".join(passage + [f"t{rng.randrange(10**6)}" for _ in range(rng.randint(45, 60))]) for _ in range(80)]  # 0.71 to 0.77 with one another
    base = [[f"w{rng.randrange(50000)}" for _ in range(rng.randint(250, 400))] for _ in range(40)]
    items = template + [" ".join(w) for w in base] + [edited_to(rng, w, 0.70 + 0.002 * i) for i, w in enumerate(base)]
    assert all(0.68 <= likeness(a, b) < 0.8 for a, b in zip(template, template[1:], strict=False))
    want = brute_kept(items)
    assert len(want) >= 150 and sorted(r.doc_id for r in simhash.keep_one(documents(spark, items)).collect()) == want


def test_keep_one_compares_block_with_block(spark, monkeypatch):
    rng = random.Random(14)
    base = [f"w{rng.randrange(50000)}" for _ in range(200)]
    items = [" ".join(base[:140] + [f"t{rng.randrange(10**6)}" for _ in range(rng.randint(20, 60))]) for _ in range(20)] + texts(40, 5)
    monkeypatch.setattr(minhash, "BLOCK", 800)
    assert sorted(r.doc_id for r in simhash.keep_one(documents(spark, items)).collect()) == brute_kept(items)


def test_short_links_find_all_that_meet_in_a_ball(spark):
    """By brute force: pairs within 2 bits in some part and within the radius are in one component, which no pair beyond the radius makes."""
    rng = random.Random(31)
    prints = {}
    for _ in range(60):
        seed = rng.getrandbits(256)
        for _ in range(rng.choice([1, 2, 2, 12])):
            x, rate = seed, rng.choice([0.02, 0.1, 0.2])
            for b in range(256):
                x ^= (rng.random() < rate) << b
            prints[len(prints) * 7 - 500] = x
    signed = lambda v: v - 2**64 if v >> 63 else v
    nodes = spark.createDataFrame([(n, [signed(x >> 64 * k & 2**64 - 1) for k in range(4)]) for n, x in prints.items()], "node long, fingerprint array<long>")
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 71]
    met = [(a, b) for a, b in near if any(((prints[a] ^ prints[b]) >> 16 * p & 0xFFFF).bit_count() <= 2 for p in range(16))]
    assert len(met) > 300
    label = {n: n for n in prints}
    for a, b in met * 4:
        label[a] = label[b] = min(label[a], label[b])
    for block, at_once in ((1024, 16), (3, 5)):
        found = {r.node: r.label for r in graph.components(simhash.short_links(nodes, bits=16, parts=16, radius=71, block=block, at_once=at_once)).collect()}
        assert {n: found.get(n, n) for n in prints} == label


def test_short_links_of_a_group_grow_with_its_members(spark, monkeypatch):
    """Near copies that share many buckets, each of many blocks: the edges that tasks give do not grow with the square of the group."""
    made = []
    frame = type(spark.range(1))
    whole = frame.mapInArrow

    def counted(df, *args):
        out = whole(df, *args)
        made.append(out.count())
        return out

    def edges(n):
        rng = random.Random(33)
        seed, prints = rng.getrandbits(256), []
        for _ in range(n):
            x = seed
            for b in rng.sample(range(256), 6):
                x ^= 1 << b
            prints.append(x)
        prints += [rng.getrandbits(256) for _ in range(50)]
        signed = lambda v: v - 2**64 if v >> 63 else v
        nodes = spark.createDataFrame([(i, [signed(x >> 64 * k & 2**64 - 1) for k in range(4)]) for i, x in enumerate(prints)], "node long, fingerprint array<long>")
        made.clear()
        label = {r.node: r.label for r in graph.components(simhash.short_links(nodes, bits=16, parts=16, radius=71, block=32, at_once=16)).collect()}
        assert label == dict.fromkeys(range(1, n), 0)
        return sum(made)

    monkeypatch.setattr(frame, "mapInArrow", counted)
    few = edges(150)
    assert edges(600) <= 4 * few + 600


def test_keep_one_meets_by_balls_of_fingerprints(spark, monkeypatch):
    rng = random.Random(32)
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    docs = documents(spark, [" ".join(words), " ".join([*words[:90], "edit", *words[91:]]), "another text of a few words"])
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [0, 2]
    monkeypatch.setattr(simhash, "short_links", lambda nodes, **_: minhash.written(nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)))
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [0, 1, 2]  # nothing else finds candidates


def test_shape_grows_with_the_table():
    assert simhash.shape(0, 0.8) == simhash.shape(240_000, 0.8) == (16, 16, 4, 71)
    for n in (10**3, 10**6, 10**7, 10**9):
        bits, parts, words, _ = simhash.shape(n, 0.8)
        assert n * (bits + 1) <= 64 * 2**bits and parts == words * (64 // bits) and bits <= 32
    assert simhash.shape(1000, 1.0)[1] == 4
