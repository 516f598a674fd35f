import base64
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from tidemark.llm import bpe

from .helpers import documents

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    with open(PATH, "rb") as file:
        return bpe.Tokenizer(file.read())


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts(tokenizer, reference):
    rng = random.Random(5)
    letters = "aAé1 2\n\t'stmdrvel!# 　中٣  '  'x\U0001f600\x1c\x85"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 50))) for _ in range(4000)]
    texts += ["", "a" * 700, "ab" * 300 + "'" * 99 + " " * 77, "don't  we'LL 'll\n 's", "<|endoftext|>"]
    for text, ids in zip(texts, tokenizer.encode(texts), strict=True):
        assert ids.tolist() == reference.encode_ordinary(text), text
        assert tokenizer.decode(ids) == text.encode()


def test_long_text_is_cut_where_a_piece_begins(tokenizer, reference, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 50)
    text = "word  it's 12 \n\n  next" * 40 + "z" * 200
    assert tokenizer.encode([text, "", text])[2].tolist() == reference.encode_ordinary(text)


def test_offsets(tokenizer):
    text = "naïve über-cats 42"
    ids = tokenizer.encode([text])[0]
    at = tokenizer.offsets(ids)
    assert b"".join(text.encode()[i:j] for i, j in zip(at, at[1:], strict=False)) == text.encode()


def test_rows(spark, reference):
    docs = documents(spark).withColumnRenamed("n_chars", "ids")
    rows = {r.doc_id: r for r in bpe.encode(docs, PATH, offsets=True, decoded=True).collect()}
    for r in docs.collect():
        assert np.frombuffer(rows[r.doc_id].ids, "<u4").tolist() == reference.encode_ordinary(r.text or "")
        assert bytes(rows[r.doc_id].decoded) == (r.text or "").encode()
    again = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert {r.doc_id: bytes(r.decoded) for r in again} == {k: bytes(r.decoded) for k, r in rows.items()}
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_workers_keep_no_pieces(spark):
    """Workers stay for other stages, in which the cache of pieces was room that nothing used."""

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(t.cache) for t in bpe._held.values())] * len(batch))], ["pieces"])

    assert len(bpe.encode(documents(spark).repartition(4), PATH).collect()) == 60
    assert {r.pieces for r in spark.range(0, 64, 1, 4).mapInArrow(held, "pieces long").collect()} == {0}
