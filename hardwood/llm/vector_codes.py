"""Vector code compression: product quantization in exact integers.

Vectors become integers ``floor(scale * x)`` and are cut into ``parts`` equal parts; each part has a codebook of
``entries`` integer vectors, refined by a fixed number of rounds. A round is one pass over the table: tasks assign
their vectors and hand on sums and counts of each entry, Spark adds those up, and the codebook (``entries`` times
the dimension numbers, whatever the table's size) goes back with the next round.

**Limb-split GEMM.** Distances are ``|x|^2 - 2 x.c + |c|^2``. An integer is split into a high and a low limb
(``x = high * 2**k + low``, low in ``[-2**(k-1), 2**(k-1))``), with ``k`` so small that a float64 BLAS product of two limb
matrices stays below 2**53 and so is exact; the products are shifted and added in int64. The first smallest distance wins.

Defined cases: rows whose vector is null or holds a null, NaN or infinity are dropped. The dimension is that of the
kept vector of the smallest id; rows of another length, and all rows if the dimension is no positive multiple of
``parts``, stay with null code and errors and train nothing. Null ids come last among the ids; rows of equal ids
all count, ordered by vector. Fewer than ``entries`` vectors give so many entries. Equal distances take the
lower entry; unused entries stay. Integers saturate at ``LIMIT`` (so that a distance fits in 64 bits). No kept rows, no result
rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import discard, materialize

#: Integers beyond this (components beyond 32768 at the scale of 4096) saturate.
LIMIT = 1 << 27


def limb_bits(width: int) -> int:
    """Bits of a low limb such that ``width`` products of two limbs sum to less than 2**53."""
    return min((53 - max(1, math.ceil(math.log2(max(width, 2))))) // 2, 24)


def _limbs(x: np.ndarray, bits: int) -> list[tuple[int, np.ndarray]]:
    """``(shift, float64 matrix)`` whose shifted sum is x; limbs that are all zero are left out."""
    out, shift = [], 0
    half = 1 << (bits - 1)
    while x.any() or not out:
        low = ((x + half) & ((1 << bits) - 1)) - half
        if low.any() or not out:
            out.append((shift, low.astype(np.float64)))
        x, shift = (x - low) >> bits, shift + bits
    return out


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x @ y.T`` of int64 matrices, exact while the result fits in 64 bits."""
    bits = limb_bits(x.shape[1])
    out = np.zeros((len(x), len(y)), np.int64)
    for s, a in _limbs(x, bits):
        for t, b in _limbs(y, bits):
            out += (a @ b.T).astype(np.int64) << (s + t)
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each row of x, and its squared distance."""
    far = (x * x).sum(1)[:, None] - 2 * exact_products(x, book) + (book * book).sum(1)[None, :]
    at = far.argmin(1)
    return at, far[np.arange(len(x)), at]


def integers(vectors: pa.Array, scale: int, dims: int) -> np.ndarray:
    """Rows of ``dims`` integers each, from an Arrow list column of finite numbers."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(scale * flat), -LIMIT, LIMIT).astype(np.int64).reshape(len(vectors), dims)


def _kept(table: DataFrame, vector: str) -> DataFrame:
    return table.where(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))


def learn_codebooks(kept: DataFrame, id_col: str, vector: str, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> np.ndarray | None:
    """Integer codebooks ``[part, entry, position]``, or None where no vector can be cut."""
    first = kept.select(id_col, vector).orderBy(F.asc_nulls_last(id_col), vector).limit(1).collect()
    dims = len(first[0][1]) if first else 0
    if not dims or dims % parts:
        return None
    width = dims // parts
    rows = kept.where(F.size(vector) == dims).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    seed = integers(pa.array([list(r.v) for r in rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()], pa.list_(pa.float64())), scale, dims)
    books = seed.reshape(len(seed), parts, width).transpose(1, 0, 2)

    def add_up(books):
        def go(batches):
            sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
            for batch in batches:
                x = integers(batch.column(0), scale, dims).reshape(-1, parts, width)
                for p in range(parts):
                    at, _ = nearest(x[:, p], books[p])
                    counts[p] += np.bincount(at, minlength=books.shape[1])
                    for e in np.unique(at):
                        sums[p, e] += x[at == e, p].sum(0)
            used = np.flatnonzero(counts.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts.ravel()[used]), pa.array(list(sums.reshape(-1, width)[used]), pa.list_(pa.int64()))], names=["cell", "n", "sums"])

        each = rows.select("v").mapInArrow(go, "cell long, n long, sums array<long>")
        return (each.select("cell", "n", F.posexplode("sums")).groupBy("cell", "pos")
                .agg(F.sum("n").alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("total")).collect())

    for _ in range(rounds):
        new = books.copy()
        for r in add_up(books):
            new[r.cell // len(seed), r.cell % len(seed), r.pos] = int(r.total) // r.n
        books = new
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress_vectors(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """``(id, code, error, label_error, codebooks_sha256)`` per kept row.

    ``code`` has two hex digits for each part (up to 256 entries); ``error`` is the squared distance to the coded
    vector; ``label_error`` its sum over rows of the same label, nulls together. The table is read once for each
    round, once for the codes, and its smallest ids once.
    """
    kept = _kept(table, vector)
    books = learn_codebooks(kept, id_col, vector, parts, entries, rounds, scale)
    if books is None:
        empty = [F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"))]
        return kept.select(id_col, *empty, F.lit(hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
    dims, width = books.shape[0] * books.shape[2], books.shape[2]

    def encode(batches):
        for batch in batches:
            fits = np.array([len(v) == dims if v is not None else False for v in batch.column("v")], bool)
            x = integers(batch.column("v").filter(pa.array(fits)), scale, dims).reshape(-1, parts, width)
            code, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                code[:, p], far = nearest(x[:, p], books[p])
                error += far
            codes, errors = np.full(len(fits), None, object), np.full(len(fits), None, object)
            codes[fits], errors[fits] = [c.tobytes().hex() for c in code], error.tolist()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("l"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["id", "l", "code", "error"])

    rows = kept.select(F.col(id_col).alias("id"), F.col(label).alias("l"), F.col(vector).cast("array<double>").alias("v"))
    coded = materialize(rows.mapInArrow(encode, T.StructType([rows.schema["id"], rows.schema["l"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])))
    by_label = coded.groupBy(F.col("l").alias("of")).agg(F.sum("error").alias("label_error"))
    out = materialize(coded.join(by_label, F.col("l").eqNullSafe(F.col("of")), "left")
                      .select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")))
    discard(coded)
    return out


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same in DuckDB's SQL: one pair of tables a round."""
    with_ = [f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""cut AS MATERIALIZED (SELECT r, p, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS x FROM kept, range({parts}) t(p))""",
             f"book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM cut WHERE r <= {entries})"]
    near = """SELECT r, cut.p, any_value(x) AS x, min(d * 256 + e) AS de FROM (SELECT r, cut.p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS d
  FROM cut JOIN book{0} b ON b.p = cut.p) cut GROUP BY r, cut.p"""
    for k in range(rounds):
        with_ += [f"near{k} AS MATERIALIZED ({near.format(k)})",
                  f"""sum{k} AS (SELECT p, e, list(s ORDER BY i) AS c FROM (SELECT p, e, i, CAST(floor_div AS BIGINT) AS s FROM (SELECT p, e, i, (sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div
  FROM (SELECT p, CAST(de % 256 AS BIGINT) AS e, unnest(x)::HUGEINT AS y, generate_subscripts(x, 1) AS i FROM near{k}) GROUP BY p, e, i)) GROUP BY p, e)""",
                  f"book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(s.c, b.c) AS c FROM book{k} b LEFT JOIN sum{k} s ON s.p = b.p AND s.e = b.e)"]
    with_ += [f"last AS ({near.format(rounds)})",
              "coded AS (SELECT r, string_agg(printf('%02x', CAST(de % 256 AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(de // 256) AS BIGINT) AS error FROM last GROUP BY r)",
              f"sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM book{rounds})"]
    return "WITH " + ",\n".join(with_) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded JOIN kept USING (r), sha"


SQL = _sql()
