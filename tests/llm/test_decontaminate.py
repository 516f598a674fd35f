import random
import re

import pytest

from tidemark.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[s : s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    found |= own
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("short", [True, False])
def test_against_brute_force(spark, short):
    rng = random.Random(4)
    vocabulary = ["Éa", "the", "Ab9", "z-z", "q", "straße", "中文"] + [f"w{i}" for i in range(30)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, say(rng.randint(12, 40))) for i in range(8)] + [(8, None), (9, ""), (10, "--")]
    items.append((11, items[0][1]))
    if short:
        items += [(None, "straße q"), (13, say(7)), (14, say(9)), (15, "w1")]
    docs = []
    for i in range(60):
        text = say(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            w = words(rng.choice(items)[1])
            low = rng.randint(0, max(0, len(w) - 5))
            text += "\n" + ", ".join(w[low : low + rng.randint(5, 25)]).upper() + ". " + say(rng.randint(0, 9))
        docs.append((i, text))
    docs += [(100, None), (101, ""), (None, items[0][1]), (103, "a " * 9000 + items[1][1]), (5, docs[5][1]), (5, "other")]
    d = spark.createDataFrame([(*x, "e", 1) for x in docs], "doc_id long, text string, items string, n int")
    b = spark.createDataFrame([(*x, "e") for x in items], "item_id long, text string, doc_id string")
    rows = decontaminate.contamination(d, b).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows), key=str)
    want = brute(docs, items)
    assert got == want
    kept = decontaminate.decontaminate(d, b)
    assert kept.columns == d.columns
    assert kept.count() == sum(x[2] == 0 for x in want)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "c")], "item_id long, text string")
    assert [tuple(r)[2:5] for r in decontaminate.contamination(d, b.limit(0)).collect()] == [(2, 0, [])]
    assert decontaminate.contamination(d.limit(0), b).count() == 0
