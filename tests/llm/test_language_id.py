import zlib

import numpy as np

from pyspark.sql import functions as F

from hardwood.llm.language_id import LENGTH, WIDTHS, Network, held_out_languages, keep_determined, train


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = held_out_languages(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert len(got) > 100 and np.mean([r.lang == r.lang_pred for r in got]) >= 0.9
    assert all(0 <= r.score <= 1 for r in got)


def test_tables_are_the_convolution():
    net = Network(["a", "b", "c"])
    x = np.random.default_rng(0).integers(0, 256, (5, LENGTH)).astype(np.uint8)
    e = net.embed[x]
    pooled = [np.stack([sum(e[:, i + j] @ net.conv[w][j] for j in range(w)) for i in range(LENGTH - w + 1)], 1).max(1) for w in net.conv]
    z = np.maximum(np.concatenate(pooled, 1), 0) @ net.dense
    want = z - np.log(np.exp(z).sum(1, keepdims=True))
    assert np.allclose(net.log_probabilities(x, net.tables()), want, atol=1e-4)


def test_whole_predictions_against_plain_convolution(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).cache()
    net = train(df.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    got = {r.doc_id: r for r in held_out_languages(df).collect()}
    for row in df.collect():
        data = np.frombuffer((row.text or "").encode(), np.uint8)
        held_out = zlib.crc32(str(row.doc_id).encode()) % 4 == 2
        r = got[row.doc_id]
        assert r.held_out == held_out
        if not any(c.isalpha() for c in row.text or ""):
            assert r.lang_pred == "und"
            continue
        total, begin = np.zeros(len(net.labels)), 0
        while begin == 0 or begin + max(WIDTHS) - 1 < len(data):
            x = np.zeros(LENGTH, np.int64)
            part = data[begin : begin + LENGTH]
            x[: len(part)] = part
            e = net.embed[x]
            pooled = [np.stack([np.tensordot(e[i : i + w], net.conv[w], ((0, 1), (0, 1))) for i in range(LENGTH - w + 1)]).max(0) + net.bias[w] for w in WIDTHS]
            z = (np.maximum(np.concatenate(pooled), 0) @ net.dense + net.out).astype(np.float64)
            total += max(len(part), 1) * (z - z.max() - np.log(np.exp(z - z.max()).sum()))
            begin += LENGTH - max(WIDTHS) + 1
        weight, begin = 0, 0
        while begin == 0 or begin + max(WIDTHS) - 1 < len(data):
            weight += max(len(data[begin : begin + LENGTH]), 1)
            begin += LENGTH - max(WIDTHS) + 1
        p = np.exp(total / weight - (total / weight).max())
        p /= p.sum()
        assert r.lang_pred == net.labels[int(p.argmax())] and abs(r.score - p.max()) < 1e-3


def test_gradient_by_differences():
    net = Network(["a", "b"])
    rnd = np.random.default_rng(1)
    x, y = rnd.integers(1, 256, (4, LENGTH)).astype(np.uint8), np.array([0, 1, 1, 0])
    loss = lambda: -net.log_probabilities(x, net.tables())[np.arange(4), y].mean()
    grads = net._gradient(x, y)
    p = net.parameters()[-2]
    for i in ((0, 0), (20, 1), (40, 0)):
        g, h = grads[-2][i], 1e-2
        p[i] += h
        up = loss()
        p[i] -= 2 * h
        down = loss()
        p[i] += h
        assert abs((up - down) / (2 * h) - g) < 2e-3


def test_edge_cases(spark):
    rows = [(i, "the cat and the dog were here " * 3, "en") for i in range(20)] + [(20 + i, "der hund und die katze waren hier " * 3, "de") for i in range(20)]
    rows += [(40, None, "en"), (41, "", None), (42, "123 !? \n", "de"), (43, "the dog and the cat " * 4000, None), (None, "und die katze der hund", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in held_out_languages(df).collect()}
    assert [got[i].lang_pred for i in (40, 41, 42)] == ["und"] * 3 and got[40].score == 0
    assert got[43].lang_pred == "en" and got[None].lang_pred == "de" and got[None].held_out is False
    kept = keep_determined(df.withColumn("score", df.doc_id)).collect()
    assert len(kept) == 42 and kept[0].__fields__ == ["doc_id", "text", "lang", "score"]
    assert {r.lang_pred for r in held_out_languages(df.where("lang is null")).collect()} == {"und"}
    assert held_out_languages(df.where("false")).collect() == []
