"""Benchmark decontamination: q-gram lemma filter in diagonal bands, then banded alignment.

Texts are compared as UTF-8 bytes with A-Z lower-cased and runs of white space as one space. An item of
m bytes is found where some region of a text is within ``e = floor(rate * m)`` edits of all of it.
By the q-gram lemma such a region shares at least ``T = m - q + 1 - q e`` q-grams with the item, all on
diagonals (place in text minus place in item) at most e apart. Every shared q-gram is counted in the two
overlapping bands that hold its diagonal; bands are 2w wide and w >= e + 1 apart, so one band holds all
diagonals of a region. Bands with T hits are verified by a banded alignment over their diagonals.
For items so short that T would be below 1, e is lowered; items shorter than q must occur as they are.

The items are read once and go to the tasks in blocks of at most ``BLOCK_BYTES`` of text; a larger
benchmark means more passes over the documents, not larger tasks. Null or blank items find nothing, null
or blank texts hold nothing. Rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import U, flat, pieces

Q, RATE, BLOCK_BYTES = 12, 0.06, 8 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[_SPACE] = 0x20


def normal(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end in the form that is compared, each followed by a zero byte."""
    space = _SPACE[data]
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    keep[first] = ~space[first]  # no space at the beginning; one at the end does no harm
    n = np.concatenate([[0], np.cumsum(keep)])[at]
    out = np.insert(_PLAIN[data[keep]], n[1:], 0)
    return out, n + np.arange(len(n))


def grams(b: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of the q bytes (8 <= q <= 16) from each place on; meaningless in the last q - 1 places of the data."""
    if len(b) < q:
        return np.empty(0, U)
    pad = np.concatenate([b, np.zeros(16, np.uint8)])
    eight = np.empty(len(b) + 8, U)
    for r in range(8):
        part = pad[r : r + (len(pad) - r) // 8 * 8].view(U)
        eight[r::8] = part[: len(eight[r::8])]
    n = len(b) - q + 1
    x = eight[:n] * U(0x9E3779B97F4A7C15) ^ (eight[q - 8 : q - 8 + n] * U(0xC2B2AE3D27D4EB4F))
    return x ^ x >> U(29)


class Items:
    """An index of q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = RATE):
        self.q = q
        data, at = normal(*flat(pa.array([t or "" for _, t in items], pa.string())))
        self.ids = np.array([i for i, _ in items], np.int64)
        self.text = [data[a : b - 1] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.text = [t[:-1] if len(t) and t[-1] == 0x20 else t for t in self.text]
        self.edits, self.least, self.short = [], [], []
        for k, t in enumerate(self.text):
            m = len(t)
            e = int(rate * m)
            while e and m - q + 1 - q * e < 1:
                e -= 1
            self.edits.append(e)
            self.least.append(m - q + 1 - q * e)
            if 0 < m < q:
                self.short.append(k)
        self.edits, self.least = np.array(self.edits, np.int64), np.array(self.least, np.int64)
        g = [grams(t, q) for t in self.text]
        key = np.concatenate([*g, np.empty(0, U)])
        item = np.repeat(np.arange(len(g)), [len(x) for x in g])
        place = np.concatenate([*[np.arange(len(x)) for x in g], np.empty(0, np.int64)]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.begin = np.unique(key[order], return_index=True)
        self.begin = np.append(self.begin, len(key))
        self.item, self.place = item[order], place[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> U(44)).astype(np.int64)] = True
        self.longest = max([len(t) for t in self.text], default=0)
        self.width = int(self.edits.max(initial=0)) + 1

    def bands(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, item and first diagonal of each band with enough hits."""
        none = np.empty(0, np.int64)
        if not len(self.keys) or len(data) < self.q:
            return none, none, none
        g = grams(data, self.q)
        where = np.flatnonzero(self.seen[(g >> U(44)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.keys, g[where]), len(self.keys) - 1)
        hit = self.keys[slot] == g[where]
        where, slot = where[hit], slot[hit]
        found = []
        step = 1 << 20  # places at a time, so that a text full of hits takes no more memory
        count = self.begin[slot + 1] - self.begin[slot]
        cuts = np.searchsorted(np.cumsum(count), np.arange(step, int(count.sum()) + step, step)) if len(count) else []
        for a, b in zip([0, *[c + 1 for c in cuts[:-1]]], [c + 1 for c in cuts], strict=True) if len(count) else []:
            w, s, n = where[a:b], slot[a:b], count[a:b]
            index = np.repeat(self.begin[s] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            text = np.searchsorted(at, np.repeat(w, n), "right") - 1
            diagonal = np.repeat(w, n) - at[text] - self.place[index] + self.longest  # not negative
            band = diagonal // self.width + 1
            item = self.item[index]
            key = (text * len(self.text) + item).astype(U) << U(32)
            found += [np.unique(key | (band - k).astype(U), return_counts=True) for k in (0, 1)]
        if not found:
            return none, none, none
        key, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        total = np.bincount(back, np.concatenate([c for _, c in found])).astype(np.int64)
        pair = (key >> U(32)).astype(np.int64)
        item = pair % len(self.text)
        enough = total >= self.least[item]
        return pair[enough] // len(self.text), item[enough], ((key[enough] & U(0xFFFFFFFF)).astype(np.int64) - 1) * self.width - self.longest

    def distances(self, k: int, texts: list[np.ndarray], first: np.ndarray) -> np.ndarray:
        """Least edits of item k against each text on diagonals ``first`` up to two widths on."""
        p = self.text[k]
        span = 2 * self.width + 1
        row = np.zeros((len(texts), len(p) + span), np.uint8)
        for i, (t, f) in enumerate(zip(texts, first, strict=True)):
            a, b = max(f, 0), min(f + row.shape[1], len(t))
            if b > a:
                row[i, a - f : b - f] = t[a:b]
        outside = np.arange(row.shape[1])[None, :] < np.maximum(-first, 0)[:, None]
        far = np.int32(1 << 20)
        ramp = np.arange(span, dtype=np.int32)
        d = np.where(outside[:, :span], far, 0).astype(np.int32)
        for i in range(len(p)):
            change = d + (row[:, i : i + span] != p[i])
            skip = np.full_like(d, far)
            skip[:, :-1] = d[:, 1:] + 1
            best = np.minimum(change, skip)
            d = np.minimum.accumulate(best - ramp, axis=1) + ramp
        return d.min(1)

    def matches(self, data: np.ndarray, at: np.ndarray) -> list[dict[int, int]]:
        """Per text ``{item id: least edits}``."""
        out: list[dict[int, int]] = [{} for _ in range(len(at) - 1)]
        text, item, first = self.bands(data, at)
        order = np.argsort(item, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(item[order])) + 1) if len(order) else []:
            k = int(item[part[0]])
            for a in range(0, len(part), 256):
                mine = part[a : a + 256]
                d = self.distances(k, [data[at[x] : at[x + 1] - 1] for x in text[mine]], first[mine])
                for x, edits in zip(text[mine].tolist(), d.tolist(), strict=True):
                    if edits <= self.edits[k]:
                        i = int(self.ids[k])
                        out[x][i] = min(edits, out[x].get(i, edits))
        for k in self.short:
            needle = self.text[k].tobytes()
            for x in range(len(out)):
                if needle in data[at[x] : at[x + 1] - 1].tobytes():
                    out[x][int(self.ids[k])] = 0
        return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size."""
    block, size = [], 0
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", F.col("text").cast("string").alias("text")).orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        if block and size + len(r["text"]) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if block:
        yield block


def find_items(documents: DataFrame, benchmark: DataFrame, *columns: str, q: int = Q, rate: float = RATE, with_text: bool = False) -> DataFrame:
    """Per row the given columns and ``found array<struct<item_id, edits>>``, by item_id; ``text`` too if asked for."""
    found = documents.select(*columns, "text", F.array().cast("array<struct<item_id:bigint,edits:bigint>>").alias("found"))
    for block in _blocks(benchmark):
        shared = documents.sparkSession.sparkContext.broadcast(block)

        def go(batches, shared=shared):
            items = Items(shared.value, q, rate)
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int64())]))
            for batch in pieces(batches):
                new = items.matches(*normal(*flat(batch.column("text"))))
                old = batch.column("found").to_pylist()
                all_ = [sorted(o + [{"item_id": i, "edits": e} for i, e in n.items()], key=lambda x: x["item_id"]) for o, n in zip(old, new, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [batch.column("text"), pa.array(all_, kind)], names=[*columns, "text", "found"])

        found = found.withColumn("text", F.col("text").cast("string"))
        found = found.mapInArrow(go, found.schema)
    return found if with_text else found.drop("text")


def contamination(documents: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """``(doc_id, contaminated, n_items, item_ids, least_edits)`` per row."""
    rows = find_items(documents, benchmark, "doc_id", q=q, rate=rate)
    return rows.select("doc_id", (F.size("found") > 0).alias("contaminated"), F.size("found").cast("long").alias("n_items"), F.col("found.item_id").alias("item_ids"), F.array_min("found.edits").alias("least_edits"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """The documents in which no item was found; columns as given."""
    rest = [c for c in documents.columns if c != "text"]  # the text goes to the workers once
    rows = documents.select(F.struct(*rest).alias("_row"), "text")
    clean = find_items(rows, benchmark, "_row", q=q, rate=rate, with_text=True).where("size(found) = 0")
    return clean.select(*[(F.col("text").cast(documents.schema["text"].dataType) if c == "text" else F.col("_row")[c]).alias(c) for c in documents.columns])
