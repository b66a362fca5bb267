"""Language ID by a byte convolutional network: multi-width filters, max pooling and softmax in numpy.

**Training** is bounded: at most about ``per_language`` labelled texts of each language, taken over
all rows by the rank of a hash of ``doc_id``, and ``windows_each`` windows of each. Every language that
labels a row has an output. Inputs are bytes of the text only.

**Prediction** covers every whole text: it is cut into windows of ``LENGTH`` bytes that overlap by the
widest filter, so each byte sequence a filter can see lies in a window; the log-probabilities of the
windows are averaged by their bytes. Batches of windows have a fixed size, so memory does not follow
the length of a text. A filter over bytes is a sum of table rows, one for each position; rows of byte
pairs are added up beforehand, which leaves three look-ups for all filters at a position.

Texts that are null or without a letter (Unicode L) get ``und`` and score 0; so do all texts if there
is nothing to learn from. Of equally likely languages the first by name is predicted. Extra columns are ignored,
repeated rows each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import flat, pieces, shape

LENGTH, WIDTHS, FILTERS, DIM, BATCH = 256, (2, 3, 4), 16, 8, 1024
UNDETERMINED = "und"


def sample(labelled: DataFrame, per_language: int) -> list[tuple[str, str]]:
    """``(text, lang)`` of about ``per_language`` rows a language, chosen by a hash over all rows."""
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    languages = counts.count()  # as many rows as the network has outputs
    share = F.broadcast(counts.select("lang", F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n")).alias("share")))
    u = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    # a bounded number of windows' bytes from a place in the text that also follows the hash
    size = F.length("text")
    start = (F.pmod(F.xxhash64("text"), F.greatest(size - 4 * LENGTH, F.lit(1)))).cast("int") + 1
    rows = labelled.join(share, "lang").select(F.substring("text", start, F.lit(4 * LENGTH)).alias("text"), "lang", (u / F.col("share")).alias("u"))
    rows = rows.where("u < 1").orderBy("u", "text").limit(2 * per_language * languages)
    return [(r["text"], r["lang"]) for r in rows.collect()]


class Network:
    """Weights and the labels they tell apart."""

    def __init__(self, labels: list[str], seed: int = 11):
        rnd = np.random.default_rng(seed)
        self.labels = labels
        self.embed = rnd.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.embed[0] = 0
        self.conv = {w: rnd.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.dense = rnd.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.out = np.zeros(len(labels), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.conv.values(), *self.bias.values(), self.dense, self.out]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, step: float = 0.004, seed: int = 3) -> None:
        """Adam on cross-entropy; x: windows of bytes, y: label numbers."""
        rnd = np.random.default_rng(seed)
        params = self.parameters()
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rnd.permutation(len(x))
            for a in range(0, len(order), 64):
                t += 1
                mine = order[a : a + 64]
                for i, (p, g) in enumerate(zip(params, self._gradient(x[mine], y[mine]), strict=True)):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.99 * v[i] + 0.01 * g * g
                    p -= step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
                self.embed[0] = 0

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n = len(x)
        e = self.embed[x]
        pooled, best, seen = [], {}, {}
        for w in WIDTHS:
            s = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2)  # n, positions, w, dim
            r = s.reshape(n, s.shape[1], -1) @ self.conv[w].reshape(-1, FILTERS) + self.bias[w]
            best[w] = r.argmax(1)
            pooled.append(np.take_along_axis(r, best[w][:, None], 1)[:, 0])
            seen[w] = np.take_along_axis(s, best[w][:, :, None, None], 1)  # n, filters, w, dim
        z = np.concatenate(pooled, 1)
        a = np.maximum(z, 0)
        p = _softmax(a @ self.dense + self.out)
        p[np.arange(n), y] -= 1
        p /= n
        da = (p @ self.dense.T) * (z > 0)
        de = np.zeros_like(self.embed)
        dconv, dbias = [], []
        for k, w in enumerate(WIDTHS):
            d = da[:, k * FILTERS : (k + 1) * FILTERS]
            dconv.append(np.einsum("nf,nfwd->wdf", d, seen[w]))
            dbias.append(d.sum(0))
            at = best[w][:, :, None] + np.arange(w)
            np.add.at(de, x[np.arange(n)[:, None, None], at], np.einsum("nf,wdf->nfwd", d, self.conv[w]))
        return [de, *dconv, *dbias, a.T @ p, p.sum(0)]

    def tables(self) -> tuple[np.ndarray, ...]:
        """Responses of all filters to a byte pair at a place and two later, and to one byte: their sums are the filters."""
        tap = {w: [self.embed @ self.conv[w][j] for j in range(w)] for w in WIDTHS}
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        return pair(*tap[2]) + self.bias[2], pair(*tap[3][:2]) + self.bias[3], tap[3][2], pair(*tap[4][:2]) + self.bias[4], pair(*tap[4][2:])

    def log_probabilities(self, windows: np.ndarray, tables: tuple) -> np.ndarray:
        """Of each window (a row of LENGTH bytes)."""
        n = len(windows)
        two, three, third, four, fourth = tables
        b = np.ascontiguousarray(windows.T)
        pair = b[:-1].astype(np.uint16) << np.uint16(8) | b[1:]
        top = [np.full((n, FILTERS), -np.inf, np.float32) for _ in WIDTHS]
        r = np.empty((n, FILTERS), np.float32)
        s = np.empty((n, FILTERS), np.float32)
        for i in range(LENGTH - 1):
            np.take(two, pair[i], 0, r, "clip")
            np.maximum(top[0], r, top[0])
            if i < LENGTH - 2:
                np.take(three, pair[i], 0, r, "clip")
                np.take(third, b[i + 2], 0, s, "clip")
                r += s
                np.maximum(top[1], r, top[1])
            if i < LENGTH - 3:
                np.take(four, pair[i], 0, r, "clip")
                np.take(fourth, pair[i + 2], 0, s, "clip")
                r += s
                np.maximum(top[2], r, top[2])
        z = np.maximum(np.concatenate(top, 1), 0) @ self.dense + self.out
        z = z.astype(np.float64)
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _cut(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows of texts of these sizes begin, and which text each is of."""
    step = LENGTH - max(WIDTHS) + 1
    count = np.maximum(1, -(-(size - (LENGTH - step)) // step))
    of = np.repeat(np.arange(len(size)), count)
    return (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * step, of


def _windows(data: np.ndarray, at: np.ndarray, begin: np.ndarray, of: np.ndarray) -> np.ndarray:
    place = (at[of] + begin)[:, None] + np.arange(LENGTH)
    inside = place < at[of + 1][:, None]
    return np.where(inside, data[np.minimum(place, max(len(data) - 1, 0))], 0) if len(data) else np.zeros(place.shape, np.uint8)


def train(labelled: DataFrame, per_language: int = 400, windows_each: int = 3) -> Network | None:
    """Fit on a bounded sample of ``labelled`` (``doc_id, text, lang``); None if there is nothing to learn."""
    rows = sample(labelled.where("lang is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"), "lang"), per_language)
    rows = [r for r in rows if any(c.isalpha() for c in r[0])]
    if not rows:
        return None
    labels = sorted({lang for _, lang in rows})
    data, at = flat(pa.array([t for t, _ in rows], pa.string()))
    begin, of = _cut(np.diff(at))
    few = begin < windows_each * LENGTH
    x = _windows(data, at, begin[few], of[few])
    y = np.array([labels.index(lang) for _, lang in rows])[of[few]]
    # short texts must be told apart too: cut some windows down
    short = x[::3].copy()
    short[np.arange(LENGTH)[None, :] >= np.random.default_rng(5).integers(12, 120, len(short))[:, None]] = 0
    net = Network(labels)
    if len(labels) > 1:
        net.fit(np.concatenate([x, short]), np.concatenate([y, y[::3]]))
    return net


def predict(documents: DataFrame, net: Network | None, *columns: str, with_text: bool = False) -> DataFrame:
    """Per row the given columns, ``lang_pred`` and ``score``, the probability of that language; ``text`` too if asked for."""
    text = F.col("text").cast("string")
    rows = documents.select(*columns, text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("_letters"))

    kept = [*columns, "text"] if with_text else list(columns)

    def go(batches: Iterator[pa.RecordBatch]):
        tables = net.tables() if net else None
        for batch in pieces(batches):
            data, at = flat(batch.column("text"))
            lang, top = np.full(batch.num_rows, UNDETERMINED, object), np.zeros(batch.num_rows)
            if net:
                size = np.diff(at)
                begin, of = _cut(size)
                total = np.zeros((batch.num_rows, len(net.labels)))
                for a in range(0, len(of), BATCH):
                    mine = slice(a, a + BATCH)
                    weight = np.maximum(np.minimum(size[of[mine]] - begin[mine], LENGTH), 1)
                    np.add.at(total, of[mine], net.log_probabilities(_windows(data, at, begin[mine], of[mine]), tables) * weight[:, None])
                p = _softmax(total / np.maximum(np.bincount(of, np.maximum(np.minimum(size[of] - begin, LENGTH), 1), batch.num_rows), 1)[:, None])
                yes = batch.column("_letters").to_numpy(zero_copy_only=False).astype(bool)
                lang[yes] = np.array(net.labels, object)[p[yes].argmax(1)]
                top[yes] = p[yes].max(1)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(lang, pa.string()), pa.array(top)], names=[*kept, "lang_pred", "score"])

    return rows.mapInArrow(go, shape(rows, kept, "lang_pred string, score double"))


def held_out_languages(documents: DataFrame, fold: int = 2, folds: int = 4, per_language: int = 400) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``; learnt where crc32(doc_id) mod ``folds`` is not ``fold``."""
    rest = F.crc32(F.col("doc_id").cast("string")) % folds
    net = train(documents.where(rest != fold), per_language)
    return predict(documents.select("doc_id", F.coalesce(rest == fold, F.lit(False)).alias("held_out"), "text"), net, "doc_id", "held_out")


def keep_determined(documents: DataFrame, languages: tuple[str, ...] | None = None, least: float = 0.0, per_language: int = 400) -> DataFrame:
    """The documents whose language is determined (one of ``languages``, if given) with score ``least`` or more; ``lang`` becomes the prediction.

    The network learns from the labelled documents themselves; ``lang`` is no input of a prediction.
    """
    net = train(documents, per_language)
    rest = [c for c in documents.columns if c != "text"]  # the text goes to the workers once
    rows = documents.select(F.struct(*rest).alias("_row"), "text")
    found = predict(rows, net, "_row", with_text=True).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    if languages is not None:
        found = found.where(F.col("lang_pred").isin(*languages))
    own = {"lang": F.col("lang_pred"), "text": F.col("text").cast(documents.schema["text"].dataType)}
    return found.select(*[own.get(c, F.col("_row")[c]).alias(c) for c in documents.columns])
