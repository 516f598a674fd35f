import hashlib
import random

import numpy as np
import public_tokenizers

import corpus_pipeline
from tidemark.llm import bpe, decontaminate, quality

from .test_decontaminate import brute as leaks
from .test_minhash import brute_clusters
from .test_secrets import ASSIGN


def corpus():
    rng = random.Random(11)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" + ("." if i % 9 == 8 else "") for i in range(n)).capitalize()
    items = [(i, say(20)) for i in range(5)]
    docs = [say(rng.randint(25, 200)) for _ in range(60)]
    junk = [" ".join(f"{w}***" for w in say(60).split()) for _ in range(8)]
    copies = [docs[0], docs[1], docs[1]]
    long = say(400)
    near = [long, long.replace(long.split()[200], "edit", 1)]
    leaked = [f"{say(30)} {t[5:90]} {say(20)}" for _, t in items]
    secret = [f"{say(30)} password=0123456789 {say(30)}"]
    return docs + junk + copies + near + leaked + secret, items


def test_against_brute_force(spark, tmp_path):
    """Quality by its own brute-forced scorer's result; the other stages by all pairs, all windows and a regular expression."""
    texts, items = corpus()
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = sorted(r.doc_id for r in quality.keep_good(docs).collect())
    assert good == [i for i, t in enumerate(texts) if "***" not in t]
    cluster = brute_clusters([texts[i] for i in good])
    distinct = [(i, texts[i]) for k, i in enumerate(good) if cluster[k] == k]
    assert len(good) - len(distinct) == 4
    bad = {x[0] for x in leaks(distinct, items) if x[2]}
    want = {i: ASSIGN.sub("[SECRET]", t) for i, t in distinct if i not in bad}
    assert sum("[SECRET]" in t for t in want.values()) == 1
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(rows) == set(want) and len(bad) == 5
    with open(public_tokenizers.path(corpus_pipeline.VOCABULARY), "rb") as file:
        tokenizer = bpe.Tokenizer(file.read())
    for i, text in want.items():
        ids = np.frombuffer(rows[i].ids, "<u4")
        assert ids.tolist() == tokenizer.encode([text])[0].tolist() and rows[i].n_tokens == len(ids)
        assert rows[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_keep_the_columns(spark):
    texts, _ = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name != "decontamination":
            assert stage(spark, docs, "").columns == docs.columns


def test_odd_rows(spark):
    """Nulls, empty texts, repeated ids and rows, clashing columns, empty tables, through every stage on its own."""
    texts, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id string, _score double, _spans string, node int, label string"
    rows = [(i, t, "en", f"s{i % 3}", len(t), f"x{i}", float(i), "y", i, "z") for i, t in enumerate(texts[:30])]
    rows += [(None, None, None, None, None, None, None, None, None, None), (None, "", "en", "s", 0, "a", 1.0, "b", 1, "c"), (3, texts[40], "en", "s", 5, "q", 0.0, "r", 2, "t"), rows[5], rows[5], (None, texts[41], "en", "s", 5, "q", 0.0, "r", 2, "t")]
    docs = spark.createDataFrame(rows, schema)
    folder = "file:/nowhere"
    bench = spark.createDataFrame(items, "item_id long, text string")
    stages = dict(corpus_pipeline.STAGES)
    stages["decontamination"] = lambda spark, docs, sf_dir: decontaminate.decontaminate(docs, bench)
    kept = {name: stage(spark, docs, folder) for name, stage in stages.items()}
    for name in ("quality", "near_duplicates", "decontamination", "secrets"):
        assert kept[name].columns == docs.columns, name
    assert kept["near_duplicates"].count() == len(rows) - 3  # two repeated rows, and null beside empty
    assert kept["decontamination"].count() == kept["secrets"].count() == kept["tokens"].count() == len(rows)
    assert {(r.doc_id, r._id, r._score, r._spans, r.node, r.label) for r in kept["secrets"].collect()} == {(x[0], *x[5:]) for x in rows}
    for name, stage in stages.items():
        assert stage(spark, docs.limit(0), folder).count() == 0, name
