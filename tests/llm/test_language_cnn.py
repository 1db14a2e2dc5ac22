import zlib

import numpy as np
from pyspark.sql import functions as F

from opinaria.llm.common import crc_remainder
from opinaria.llm.language_cnn import ByteCnn, predict, train, windows_of

SF = "/root/testdata/sf0.1/documents.parquet"


def test_windows_cover_the_whole_text():
    text = "Äb".encode() * 300
    assert windows_of(text, 128).tobytes().rstrip(b"\0") == text.lower() and windows_of(b"", 128).shape == (0, 128)


def loss(model, x, y):
    return -np.log(model.probabilities(x)[np.arange(len(x)), y].astype(float)).mean()


def test_gradients_equal_differences():
    model = ByteCnn(["a", "b", "c"], length=16, filters=2)
    draw = np.random.default_rng(0)
    x, y = draw.integers(97, 103, (6, 16), dtype=np.uint8), np.array([0, 1, 2, 1, 1, 0])
    names = ["embed", "conv", "conv_bias", "out", "out_bias"]
    for name in names:
        setattr(model, name, getattr(model, name).astype(float))
    grads, step = model.gradients(x, y), 1e-6

    def forward():
        top, _ = model._pooled(model._patches(x))
        z = top @ model.out + model.out_bias
        return (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(x)), y]).mean()

    for name in names:
        values = getattr(model, name)
        assert grads[name].shape == values.shape
        free = np.argwhere(model.mask > 0) if name == "conv" else np.argwhere(np.ones(values.shape, bool))
        if name == "embed":
            free = free[np.isin(free[:, 0], [0, *range(97, 104)])]
        for at in map(tuple, free[:: max(1, len(free) // 60)]):
            was = values[at]
            values[at] = was + step
            above = forward()
            values[at] = was - step
            below = forward()
            values[at] = was
            assert abs((above - below) / (2 * step) - grads[name][at]) < 1e-6, (name, at)
    assert (grads["conv"][model.mask == 0] == 0).all()


def test_training_lowers_the_loss():
    model = ByteCnn(["a", "b"], length=16, filters=2)
    draw = np.random.default_rng(0)
    x, y = draw.integers(97, 123, (6, 16), dtype=np.uint8), np.array([0, 1, 0, 1, 1, 0])
    before = loss(model, x, y)
    model.train(x, y, epochs=40, batch=6, rate=1e-2)
    assert loss(model, x, y) < 0.2 * before


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SF).select("doc_id", "text", "lang")
    model = train(docs, crc_remainder("doc_id", 4) != 2, per_language=300, max_windows=8000)
    rows = predict(docs.where(crc_remainder("doc_id", 4) == 2), model).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    right = np.mean([r.lang_pred == r.lang for r in rows if r.lang])
    assert right > 0.97, right
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts(spark):
    rows = [(1, "the thing", "en", 5), (2, "für ungen", "de", 5), (3, None, "en", 1), (4, "12 !? _", None, 1), (5, "", "de", 1), (None, "é", None, 1), (1, "x" * 50_000, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = train(docs, F.col("doc_id").isNotNull())
    got = predict(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.lang_pred in (("en", "de") if r.text and any(c.isalpha() for c in r.text) else ("und",))
    assert {r.lang_pred for r in predict(docs, train(docs.limit(0), F.lit(True))).collect()} == {"und"}
    assert predict(docs.limit(0), model).collect() == []
