import random

import numpy as np
import pytest

from tidemark.llm import common, suffixes


def brute(docs):
    """docs: (order, text) in order; rows alike are one document."""
    seen, out = {}, []
    for doc, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            if seen.setdefault(data[i : i + 100], (doc, i)) != (doc, i):
                gone[i : i + 100] = b"\1" * 100
        spans = bytes(gone).replace(b"\0", b" ").split()
        out.append((len(data), sum(gone), len(spans), bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    say = lambda n: " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(n))
    passages = [say(60) for _ in range(5)]
    out = [None, "", "x" * 99, "y" * 100, "y" * 101, "Repeat " * 200, "ab" * 2000, passages[0]]
    for _ in range(40):
        text = say(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            low = rng.randint(0, len(p) - 1)
            text += p[low : low + rng.randint(50, 300)] + rng.choice(["", say(3), "é" * rng.randint(0, 60)])
        out.append(text)
        if rng.random() < 0.3:
            out.append(text)
    return out


@pytest.mark.parametrize("many", [0, 256])
def test_against_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(suffixes, "MANY", many)
    texts = corpus(many)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(3)
    rows = {r.doc_id: r for r in suffixes.remove_repeats(docs).collect()}
    for i, want in enumerate(brute(list(enumerate(texts)))):
        r = rows[i]
        assert (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) == want, i
    assert len(rows) == len(texts)


def test_hot_anchors_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "MANY", 2)
    monkeypatch.setattr(common, "HOT", 1 << 40)
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    texts = corpus(3) * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r.doc_id: bytes(r.kept) for r in suffixes.remove_repeats(docs).collect()}
    assert [rows[i] for i in range(len(texts))] == [x[3] for x in brute(list(enumerate(texts)))]


def test_rows_alike_null_ids_and_empty(spark):
    text = "".join(random.Random(4).choices("abcdefgh", k=150))
    docs = spark.createDataFrame([(2, text), (2, text), (None, text), (7, "z" + text)], "doc_id long, text string")
    rows = sorted(((r.doc_id or -1), bytes(r.kept).decode()) for r in suffixes.remove_repeats(docs).collect())
    assert rows == [(-1, text), (2, ""), (2, ""), (7, "z")]
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


def test_texts_of_one_id(spark, monkeypatch):
    """Different texts of one id, many null ids, rows alike: each against brute force, in the order of id and text hash."""
    import xxhash

    monkeypatch.setattr(suffixes, "MANY", 4)
    texts = corpus(5)
    rng = random.Random(5)
    rows = [(rng.choice([None, None, 3, 3, i]), t) for i, t in enumerate(texts)] + [(None, texts[20]), (1, texts[30]), (1, texts[30])]
    signed = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), 42) + 2**63) % 2**64
    order = sorted({(-1 if i is None else i, signed(t), t or "") for i, t in rows})
    want = {(i, t): x for (i, _, t), x in zip(order, brute([(k, t) for k, (_, _, t) in enumerate(order)]), strict=True)}
    found = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in found)
    assert got == sorted((-1 if i is None else i, *want[-1 if i is None else i, t or ""]) for i, t in rows)


def test_long_texts_are_scanned_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 150)
    rng = random.Random(1)
    a = "".join(rng.choices("abcdefgh", k=2000))
    texts = [a, a[300:900] + "é" + a[100:700]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: bytes(r.kept) for r in suffixes.remove_repeats(docs).collect()}
    assert [rows[i] for i in range(2)] == [x[3] for x in brute(list(enumerate(texts)))]


def test_suffix_array():
    rng = np.random.default_rng(2)
    for n, letters in ((1, 2), (40, 2), (400, 3), (400, 250)):
        data = np.append(rng.integers(1, letters + 1, n), 0).astype(np.uint8)
        raw = bytes(data)
        got = suffixes.suffix_array(data, 30).tolist()
        assert sorted(got) == list(range(len(raw)))
        cut = [raw[i : i + 30].ljust(30, b"\0") for i in got]
        assert cut == sorted(cut)
        prefix = suffixes.common_prefixes(data, np.array(got), 30).tolist()
        assert prefix[1:] == [next((k for k in range(30) if a[k] != b[k]), 30) for a, b in zip(cut, cut[1:], strict=False)]
