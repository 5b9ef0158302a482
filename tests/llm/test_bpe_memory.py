"""What a task of the byte-pair encoder holds is bounded, and nothing of the result depends on it."""

import pyarrow as pa

from tickloom.llm import bpe
from tickloom.llm.queries import vocabulary_path


def test_portions_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(bpe, "CHARACTERS", 100)
    texts = ["x" * n for n in (0, 60, 40, 1, 500, 99, 2)] + [None] * 300 + ["é" * 50, "y"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"]).slice(1)
    parts = list(bpe._portions(batch))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts[1:]
    size = lambda p: sum(len((t or "").encode()) for t in p.column(1).to_pylist())
    assert all(p.num_rows == 1 or p.num_rows <= bpe.ROWS and size(p) <= 100 for p in parts)
    assert list(bpe._portions(batch.slice(0, 0))) == []


def test_old_words_go_and_frequent_ones_stay(monkeypatch):
    v = bpe.load(vocabulary_path())
    lists = [["the same words " + " ".join(f"x{k}y{j}" for j in "abcdefgh")] for k in range(200)]
    want = [list(bpe.Encoder(v).encode(t)) for t in lists]
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    e, asked = bpe.Encoder(v), []
    real = bpe.encode_words
    monkeypatch.setattr(bpe, "encode_words", lambda words, v: asked.extend(words) or real(words, v))
    assert [list(e.encode(t)) for t in lists] == want
    assert len(e.ids) + len(e.older) < 200
    assert asked.count("same") == 1


def test_ids_without_the_decoded_text(spark, docs):
    rows = docs((1, None), (2, ""), (3, "Hello there"), (None, "x y"))
    both = bpe.encode_documents(spark, rows, vocabulary_path(), texts=True).drop("decoded")
    ids = bpe.encode_documents(spark, rows, vocabulary_path(), ids=True)
    assert ids.schema == both.schema and "decoded" not in ids.columns
    assert sorted(map(repr, ids.collect())) == sorted(map(repr, both.collect()))
