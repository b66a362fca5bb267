import glob
import math
import os
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from hardwood.llm import kneser_ney
from hardwood.llm.kneser_ney import discounts, held_out_scores
from hardwood.llm.storage import CLEAN


def brute(rows, order=3):
    tok = {d: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</s>"] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tok}
    grams = lambda w: [tuple((["<s>"] * (order - 1) + w)[i : i + order]) for i in range(len(w))]
    c, count = Counter(), {order: Counter()}
    for d, w in tok.items():
        if not held[d]:
            c.update(w)
            count[order].update(grams(w))
    for n in range(order - 1, 0, -1):
        count[n] = Counter(g[1:] for g in count[n + 1])
    n_tokens, v = sum(c.values()), len(c)
    disc = {n: discounts([sum(x == k for x in count[n].values()) for k in (1, 2, 3, 4)]) for n in count}
    cut = lambda dd, k: 0 if k == 0 else dd[min(k, 3) - 1]
    total, rest = {n: Counter() for n in count}, {n: Counter() for n in count}
    for n in count:
        for g, k in count[n].items():
            total[n][g[:-1]] += k
            rest[n][g[:-1]] += cut(disc[n], k)

    def p(*g):
        if len(g) == 1:
            k = count[1][g]
            return (max(k - cut(disc[1], k), 0) + rest[1][()] / (v + 1)) / total[1][()]
        n, low = len(g), p(*g[1:])
        if not total[n][g[:-1]]:
            return low
        k = count[n][g]
        return (max(k - cut(disc[n], k), 0) + rest[n][g[:-1]] * low) / total[n][g[:-1]]

    return {i: (held[i], len(w), sum(c[x] > 0 for x in w), n_tokens, sum(math.log10((c[x] + 1) / (n_tokens + v + 1)) for x in w),
                sum(math.log10(p(*g)) for g in grams(w))) for i, w in tok.items()}, p, c


@pytest.mark.parametrize("order", [2, 3, 4])
def test_table_against_brute_force(spark, order):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want, p, c = brute([(r.doc_id, r.text) for r in df.collect()], order)
    got = held_out_scores(df, order=order).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert math.isclose(r.base_score, w[4], rel_tol=1e-9) and math.isclose(r.score, w[5], rel_tol=1e-9)
    for a in (["<s>"] * (order - 1), ["<s>"] * (order - 2) + ["the"], ["nowhere"] * (order - 1)):
        assert math.isclose(sum(p(*a, b) for b in [*c, "unseen"]), 1, rel_tol=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_shares_and_flushes(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    monkeypatch.setattr(kneser_ney, "SHARE", 5000)
    monkeypatch.setattr(kneser_ney, "HELD", 3000)
    want = brute([(r.doc_id, r.text) for r in df.collect()])[0]
    assert all(math.isclose(r.score, want[r.doc_id][5], rel_tol=1e-9) for r in held_out_scores(df).collect())


def test_nulls_long_texts_and_no_training(docs, spark):
    got = {r.doc_id: r for r in held_out_scores(docs(None, "", "A a", "b", "z y " * 200_000)).collect()}
    assert got[0].n_tokens == 1 and got[2].n_tokens == 3 and got[4].n_tokens == 400_001
    none = held_out_scores(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()[0]
    assert none.train_tokens == 0 and none.score == 0 and none.held_out is False
    assert held_out_scores(docs("x").where("false")).collect() == []


def test_codes_of_counts_and_sums():
    """Round trip, with those that have no code."""
    counts = np.array([1, 2, 254, 255, 256, 70_000, 3], np.int64)
    rows = np.array([(1, 1, 0, 0), (15, 15, 0, 0), (16, 16, 0, 0), (29, 15, 3, 1), (8, 0, 4, 0), (15 + 6 + 9 + 254, 15, 3, 3), (15 + 6 + 9 + 255, 15, 3, 3), (90_000, 1, 0, 2)], np.int64)
    for values in (counts, rows):
        back = kneser_ney._decoded(*kneser_ney._coded(values), np.arange(len(values))[::-1])
        assert (back[::-1] == values.reshape(len(values), -1)).all()
    assert len(kneser_ney._coded(counts)[1]) == 3 and kneser_ney._coded(rows)[1].tolist() == [2, 4, 6, 7]


def test_model_and_shuffles_take_little_disk(spark):
    """A byte a count, two a context, and no shuffle file left by training."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    spark._jvm.System.gc()
    before = tracker.shuffleStatuses().size()
    model = kneser_ney.train(df)
    sizes = {part: [os.path.getsize(f) for f in sorted(glob.glob(f"{model.folder}/{part}"))] for part in ("g3-*.low", "g3-*.counts", "x3-*.low", "x3-*.sums")}
    assert sizes["g3-*.low"] == [2 * n for n in sizes["g3-*.counts"]] and sizes["x3-*.low"] == sizes["x3-*.sums"]
    assert tracker.shuffleStatuses().size() <= before + 4  # those of a few small counts
    assert spark.conf.get(CLEAN) == "false"


def test_tasks_hold_few_bytes_an_ngram():
    """Counting a flush, reading a share and look-ups keep no second copy of what they hold."""
    rnd, n = np.random.default_rng(3), 400_000
    columns = [rnd.integers(0, 400, n).astype(np.uint32) for _ in range(3)]
    share = kneser_ney.shares_of(kneser_ney.gram_keys(columns), 16).astype(np.uint32)
    want = Counter(zip(*[c.tolist() for c in columns], strict=True))
    tracemalloc.start()
    parts = [data for _, data in kneser_ney._packed(columns, None, share, 16)]
    flush = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    columns, keys, counts = kneser_ney._distinct(*kneser_ney._unpacked(parts, 3))
    read = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert dict(zip(zip(*[c.tolist() for c in columns], strict=True), counts.tolist(), strict=True)) == want
    assert flush < 40 * n and read < 100 * n, (flush / n, read / n)


def test_sorted_places_is_a_stable_argsort():
    rnd = np.random.default_rng(4)
    for keys in (np.empty(0, np.uint64), np.array([7], np.uint32), rnd.integers(0, 9, 5000).astype(np.uint32), rnd.integers(0, 2**64, 5000, dtype=np.uint64),
                 np.repeat(rnd.integers(0, 2**64, 700, dtype=np.uint64), 7), np.uint64(2**63) + rnd.integers(0, 5000, 5000).astype(np.uint64), np.full(9, 2**64 - 1, np.uint64)):
        assert kneser_ney._sorted_places(keys).tolist() == np.argsort(keys, kind="stable").tolist()
