import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from hardwood.llm.vector_codes import compress_vectors, exact_products, integers, limb_bits, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    """Python's own integers, entry by entry."""
    kept = sorted(((i, [int(np.floor(4096 * float(np.float32(x)))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)), key=lambda r: (r[0], r[1]))
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for c in cut:
                mine.setdefault(best(c[p], books[p]), []).append(c[p])
            books[p] = [[sum(x) // len(mine[e]) for x in zip(*mine[e], strict=True)] if e in mine else b for e, b in enumerate(books[p])]
    codes = [[best(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(far(c[p], books[p][k[p]]) for p in range(parts)) for c, k in zip(cut, codes, strict=True)]
    by = {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        by[lab] = by.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((i, "".join(f"{x:02x}" for x in k), e, by[lab], sha) for (i, _, lab), k, e in zip(kept, codes, errors, strict=True))


def test_limb_products_are_exact():
    rnd = random.Random(1)
    for bits, width in ((3, 8), (20, 8), (27, 7), (27, 96), (14, 1)):
        x, y = (np.array([[rnd.randrange(-(1 << bits), (1 << bits) + 1) for _ in range(width)] for _ in range(n)]) for n in (9, 5))
        x[0], y[0] = 1 << bits, -(1 << bits)
        assert exact_products(x, y).tolist() == [[sum(a * b for a, b in zip(u, v, strict=True)) for v in y.tolist()] for u in x.tolist()]
        assert width * (1 << (limb_bits(width) - 1)) ** 2 < 2**53
    at, far = nearest(np.array([[1, 1], [5, 5]]), np.array([[2, 2], [0, 0], [2, 2]]))
    assert at.tolist() == [0, 0] and far.tolist() == [2, 18]


def test_floors_go_down():
    assert integers(pa.array([[-0.00001, 0.00001]]), 4096, 2).tolist() == [[-1, 0]]


def test_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert sorted(tuple(r) for r in compress_vectors(df).collect()) == brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])


def test_nulls_ties_repeats_and_wide_numbers(spark):
    rnd = random.Random(3)
    vec = lambda s=1.0: [float(np.float32(rnd.gauss(0, s))) for _ in range(16)]
    same = vec()
    rows = [(k, same if k % 3 == 0 else vec(1 if k % 7 else 5000), None if k % 4 == 0 else k % 3) for k in range(60)]
    rows += [(rows[5][0], *rows[5][1:]), (100, None, 1), (101, [None] + same[1:], 1), (102, [float("nan")] + same[1:], 1), (103, [float("-inf")] + same[1:], None)]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA + ", code string, error int")
    assert sorted(tuple(r) for r in compress_vectors(df).collect()) == brute(rows)
    few = df.where("vec_id in (0, 1, 2)")
    assert sorted(tuple(r) for r in compress_vectors(few).collect()) == brute([r for r in rows if r[0] in (0, 1, 2)])
    assert compress_vectors(df.where("false")).collect() == []


@pytest.mark.parametrize("length", [0, 12])
def test_vectors_that_cannot_be_cut(spark, length):
    odd = spark.createDataFrame([(1, [1.0] * length, 1), (None, [1.0] * 16, 2)], SCHEMA)
    assert {(r.vec_id, r.code, r.error) for r in compress_vectors(odd).collect()} == {(1, None, None), (None, None, None)}
    mixed = spark.createDataFrame([(1, [1.0] * 16, 1), (2, [2.0] * length, 1), (None, [1.0] * 16, 1)], SCHEMA)
    assert {(r.vec_id, r.code, r.label_error) for r in compress_vectors(mixed).collect()} == {(1, "00" * 8, 0), (2, None, 0), (None, "00" * 8, 0)}
