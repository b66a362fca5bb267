"""Substring dedup by seed and extend: word passages that a smaller document already has.

1. **Seeds.** Every window of ``length`` words picks the smallest hash among its runs of ``seed``
   words (winnowing), so equal windows pick equal seeds. A join on seeds keeps those that two
   documents have.
2. **Extension.** A document's shared seeds are extended both ways to all windows that picked them;
   one aggregation finds the smallest document in which each such window starts. No pair of
   documents is ever formed, so a passage in a third of all documents costs one row per occurrence.
3. **Maximal repeats.** Consecutive windows known from a smaller document merge into the maximal
   repeats of at least ``length`` words, which are cut.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Null and blank texts have no words. Rows with a null
``doc_id`` are kept whole and are no source for others; rows that share a ``doc_id`` are one
document to the rule (a repeat needs a *smaller* id), each gives a row, and each loses its own words only.
Windows are matched by two hashes of their words, 96 bits in all. Ids may be of any orderable type. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .identity import ROW, numbered
from .storage import discard, materialize
from .textarrays import U, Words, list_column, mix, pieces, runs


def _lowest(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values."""
    done = 1
    while done * 2 <= width:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    rest = width - done
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def _seeds(h: np.ndarray, length: int, seed: int) -> np.ndarray:
    """For each word at which a window could begin, the window's seed (texts not told apart)."""
    return _lowest(runs(h, seed), length - seed + 1) if len(h) >= length else np.empty(0, U)


def _plain(words: Words, keep: np.ndarray | None = None) -> tuple[bytes, np.ndarray]:
    """The kept words, each followed by a space, and where those of each text end."""
    start, end, at = words.start, words.end, words.at
    if keep is not None:
        count = np.concatenate([[0], np.cumsum(keep)])
        start, end, at = start[keep], end[keep], count[at]
    size = end - start + 1
    ends = np.cumsum(size)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    step = np.ones(len(out), np.int64)
    if len(ends):
        step[0] = start[0]
        step[ends[:-1]] = start[1:] - end[:-1]
        src = np.cumsum(step)
        word = np.ones(len(out), bool)
        word[ends - 1] = False
        out[word] = words.data[src[word]]
    return out.tobytes(), np.concatenate([[0], ends])[at]


def _digests(words: Words, keep: np.ndarray | None = None) -> list[str]:
    text, at = _plain(words, keep)
    return [hashlib.sha256(text[a : b - 1] if b > a else b"").hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]


def _texts(words: Words, keep: np.ndarray | None = None) -> list[str]:
    text, at = _plain(words, keep)
    return [(text[a : b - 1] if b > a else b"").decode() for a, b in zip(at[:-1], at[1:], strict=True)]


def repeats(documents: DataFrame, length: int = 50, seed: int = 17) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents with a number each (see :func:`numbered`), ``(doc_id, n_words, kept_sha256)`` of all rows before any cut with the number, and ``(number, starts)``.

    ``starts`` holds the word positions at which a window begins that also starts in a smaller document. The last two are tables.
    """
    rows, names = numbered(documents)
    kind = documents.schema["doc_id"].dataType

    def profile(batches):
        for batch in pieces(batches):
            words = Words(batch.column("text"), lower=False)
            low = _seeds(words.hashes(), length, seed)
            found = [np.unique(low[a : b - length + 1]) if b - a >= length else low[:0] for a, b in zip(words.at[:-1], words.at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column(ROW), pa.array(np.diff(words.at)), pa.array(_digests(words)),
                list_column(np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])]))],
                names=["doc_id", ROW, "n_words", "kept_sha256", "seeds"])

    def extend(batches):
        for batch in pieces(batches):
            words = Words(batch.column("text"), lower=False)
            h = words.hashes()
            low, whole, check = _seeds(h, length, seed), runs(h, length), runs(mix(h), length)
            shared, number = batch.column("shared"), batch.column(ROW).to_numpy()
            for d, (a, b) in enumerate(zip(words.at[:-1], words.at[1:], strict=True)):
                if b - a >= length:
                    mine = np.sort(shared[d].values.to_numpy().view(U))
                    own = low[a : b - length + 1]
                    at = np.flatnonzero(mine[np.minimum(np.searchsorted(mine, own), len(mine) - 1)] == own)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number[d])), pa.array(whole[a + at].view(np.int64)), pa.array((check[a + at] >> U(32)).astype(np.uint32).view(np.int32)), pa.array(at.astype(np.int32))],
                                                     names=[ROW, "window", "check", "at"])

    texts = rows.select("doc_id", ROW, F.col("text").cast("string").alias("text"))
    fields = T.StructType([T.StructField("doc_id", kind), T.StructField(ROW, T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("seeds", T.ArrayType(T.LongType()))])
    base = materialize(texts.mapInArrow(profile, fields))
    seeds = base.where(F.col(ROW).isNotNull()).select(ROW, F.explode("seeds").alias("seed"))
    shared = seeds.groupBy("seed").agg(F.min(ROW).alias("x"), F.max(ROW).alias("y")).where("x < y").select("seed")
    mine = materialize(seeds.join(shared, "seed").groupBy(ROW).agg(F.collect_set("seed").alias("shared")))
    windows = materialize(texts.dropDuplicates([ROW]).join(mine, ROW).mapInArrow(extend, f"{ROW} long, window long, check int, at int") if names is not None else
                          texts.join(mine, ROW).mapInArrow(extend, f"{ROW} long, window long, check int, at int"))
    discard(mine)
    first = windows.groupBy("window", "check").agg(F.min(ROW).alias("x"), F.max(ROW).alias("y")).where("x < y").select("window", "check", "x")
    cut = windows.join(first, ["window", "check"]).where(F.col(ROW) > F.col("x"))
    if names is not None:  # texts of one id are one document: the smallest one must have a smaller id
        name = lambda r: names.select(F.col(ROW).alias(r), F.col("__id").alias(f"{r}_id"))
        cut = cut.withColumnRenamed(ROW, "row").join(name("row"), "row").join(name("x"), "x").where("x_id < row_id").withColumnRenamed("row", ROW)
    cut = materialize(cut.groupBy(ROW).agg(F.collect_set("at").alias("starts")))
    discard(windows)
    return rows, base, cut


def _mask(words: Words, starts: pa.Array, length: int) -> np.ndarray:
    """Which words stay when the windows that begin at ``starts`` are cut."""
    edge = np.zeros(len(words) + length + 1, np.int32)
    for d, a in enumerate(words.at[:-1]):
        s = starts[d].values.to_numpy()
        s = a + s[s <= words.at[d + 1] - a - length]  # a window lies within its text
        np.add.at(edge, s, 1)
        np.add.at(edge, s + length, -1)
    return np.cumsum(edge)[: len(words)] == 0


def substring_digests(documents: DataFrame, length: int = 50, seed: int = 17) -> DataFrame:
    """Per row ``(doc_id, n_words, n_removed, kept_sha256)``: kept words joined by one space."""

    def go(batches):
        for batch in pieces(batches):
            words = Words(batch.column("text"), lower=False)
            keep = _mask(words, batch.column("starts"), length)
            gone = np.concatenate([[0], np.cumsum(~keep)])[words.at]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(words.at)), pa.array(np.diff(gone)),
                                              pa.array(_digests(words, keep))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows, base, cut = repeats(documents, length, seed)
    out = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    changed = rows.select("doc_id", ROW, F.col("text").cast("string").alias("text")).join(cut, ROW).select("doc_id", "text", "starts").mapInArrow(go, out)
    same = base.join(cut.select(ROW), ROW, "left_anti").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    digests = materialize(same.unionByName(changed))
    discard(base, cut)
    return digests


def cut_repeats(documents: DataFrame, length: int = 50, seed: int = 17) -> DataFrame:
    """The documents with repeats cut from ``text`` (words of a changed text are joined by one space)."""

    def go(batches):
        for batch in pieces(batches):
            words = Words(batch.column("text"), lower=False)
            keep = _mask(words, batch.column("starts"), length)
            yield pa.RecordBatch.from_arrays([batch.column("__whole"), pa.array(_texts(words, keep))], names=["__whole", "__cut"])

    rows, base, cut = repeats(documents, length, seed)
    discard(base)
    rows = rows.select(F.struct(*documents.columns).alias("__whole"), ROW, F.col("text").cast("string").alias("text"))
    changed = rows.join(cut, ROW).select("__whole", "text", "starts").mapInArrow(go, T.StructType([rows.schema["__whole"], T.StructField("__cut", T.StringType())]))
    changed = changed.select(*[F.col("__cut").alias(c) if c == "text" else F.col("__whole")[c].alias(c) for c in documents.columns])
    same = rows.join(cut.select(ROW), ROW, "left_anti").select(*[F.col("__whole")[c].alias(c) for c in documents.columns])
    return same.unionByName(changed)
