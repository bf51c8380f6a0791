"""A wrong result of the agenda is an error, whichever text of a batch it is for."""

import pytest

from wayfold.llm import queries, sentencepiece_codec


@pytest.mark.parametrize("wrong", [0, 5, 17])
def test_each_text_is_held_against_the_library(monkeypatch, wrong):
    own = sentencepiece_codec.codec(queries.piece_model())
    texts = [f"text {i} of a batch" for i in range(20)]
    sound = own.encode_batch
    assert own.checked_batch(texts) == sound(texts)
    monkeypatch.setattr(own, "encode_batch", lambda t: [(n + 1, ids, s) if i == wrong else (n, ids, s) for i, (n, ids, s) in enumerate(sound(t))])
    with pytest.raises(ValueError, match="1 of 20 texts"):
        own.checked_batch(texts)


def test_the_query_checks_every_text(monkeypatch, spark):
    """The function that workers run, on one batch: text 5 isn't among each sixteenth."""
    import pyarrow as pa

    taken = {}
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, schema: taken.setdefault("f", f))
    docs = spark.createDataFrame([(0, "a")], "doc_id long, text string")
    sentencepiece_codec.encode_and_decode(docs, queries.piece_model())
    own = sentencepiece_codec.codec(queries.piece_model())
    sound = own.encode_batch
    monkeypatch.setattr(own, "encode_batch", lambda t: [(n + 1, ids, s) if i == 5 else (n, ids, s) for i, (n, ids, s) in enumerate(sound(t))])
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(20)), "text": [f"text {i}" for i in range(20)]})
    with pytest.raises(ValueError):
        list(taken["f"](iter([batch])))
