"""Documents for the tests: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

WORDS = "the cat sat on a mat and then Ran away from Élan big dog 42 über zu naïve of to in".split()


def texts(n=60, seed=3):
    rng = random.Random(seed)
    out = [None, "", " ", "one", "One two", "x" * 3000, "a b " * 4000]
    while len(out) < n:
        base = " ".join(rng.choices(WORDS, k=rng.randint(1, 120)))
        out.append(base)
        if rng.random() < 0.4:
            out.append(base)
        if rng.random() < 0.4:
            words = base.split()
            words[rng.randrange(len(words))] = "changed"
            out.append(" ".join(words))
    return out[:n]


def documents(spark, items=None):
    items = texts() if items is None else items
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(items)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
