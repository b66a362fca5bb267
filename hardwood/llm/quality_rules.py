"""Quality rules as a short-circuit cascade, ordered by rejections per cost on a sample.

Every rule looks only at the texts that the rules before it let pass. Cost (seconds a text) and
selectivity are measured, where the rows lie, on whole texts of a sample of about ``sample_rows`` rows taken
over all rows by hash; rules run by falling rejections per second. The order changes the time, never the verdict, which is
that no rule rejects.

Base measures are counted for every text. Words are ``[^\\x20\\x09-\\x0D]+``; null is a text without
words. Rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

import time
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import U, Words, mix, pieces, runs, shape

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True

_LEAD = (np.arange(256) & 0xC0) != 0x80  # one byte of each character


class Texts:
    """A batch of texts with what rules measure; each measure is worked out for the asked rows only."""

    def __init__(self, text: pa.Array):
        self.words = Words(text, lower=False)
        self.n_words = np.diff(self.words.at)

    def of(self, rows: np.ndarray) -> list[np.ndarray]:
        at, data = self.words.text_at, self.words.data
        return [data[at[r] : at[r + 1]] for r in rows]

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[self.words.text_at])

    def word_sizes(self) -> np.ndarray:
        """Characters of each word."""
        before = np.concatenate([[0], np.cumsum(_LEAD[self.words.data])])
        return before[self.words.end] - before[self.words.start]

    def base(self) -> dict[str, np.ndarray]:
        w = self.words
        solid = ~_SPACE[w.data]
        return {"n_words": self.n_words, "word_chars": self.per_text(solid & ((w.data & 0xC0) != 0x80)), "n_symbols": self.per_text(_SYMBOL[w.data]),
                "n_dup_lines": np.array([self._repeated_lines(t) for t in self.of(np.arange(len(self.n_words)))], np.int64), "n_repeat_words": self._repeat_words(5)}

    @staticmethod
    def _repeated_lines(t: np.ndarray) -> int:
        seen, n = set(), 0
        for line in t.tobytes().split(b"\n"):
            if line.strip(b" \t\n\x0b\x0c\r"):
                n += line in seen
                seen.add(line)
        return n

    def _repeat_words(self, width: int) -> np.ndarray:
        """Words in windows of ``width`` words that the same text has twice or more."""
        w = self.words
        n = len(w) - width + 1
        if n < 1:
            return np.zeros(len(self.n_words), np.int64)
        of = np.repeat(np.arange(len(self.n_words)), self.n_words)
        h = mix(runs(w.hashes(), width) ^ mix(of[:n].astype(U)))
        inside = of[:n] == of[width - 1 :]
        at = np.flatnonzero(inside)
        _, back, count = np.unique(h[at], return_inverse=True, return_counts=True)
        edge = np.zeros(len(w) + 1, np.int64)
        twice = at[count[back] > 1]
        edge[twice] += 1
        np.subtract.at(edge, twice + width, 1)
        return np.diff(np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])[w.at])


Rule = Callable[[Texts, np.ndarray], np.ndarray]


def _share(flags: np.ndarray, most: float) -> Rule:
    def reject(t: Texts, rows: np.ndarray) -> np.ndarray:
        return np.array([flags[x].sum() / max((~_SPACE[x] & _LEAD[x]).sum(), 1) for x in t.of(rows)]) > most

    return reject


def _letters(t: Texts, rows: np.ndarray) -> np.ndarray:
    """Fewer than 0.4 of the characters are letters, marks on letters included; those beyond ASCII by their Unicode category."""
    share = []
    for x in t.of(rows):
        beyond = Counter(x[x >= 0x80].tobytes().decode("utf-8", "replace"))
        n = _LETTER[x].sum() + sum(k for c, k in beyond.items() if unicodedata.category(c)[0] in "LM")
        share.append(n / max((~_SPACE[x] & _LEAD[x]).sum(), 1))
    return np.array(share) < 0.4


def _word_length(t: Texts, rows: np.ndarray) -> np.ndarray:
    w = t.words
    size = np.concatenate([[0], np.cumsum(t.word_sizes())])[w.at]
    mean = np.diff(size)[rows] / np.maximum(t.n_words[rows], 1)
    return (mean < 2) | (mean > 20)


def _long_word(t: Texts, rows: np.ndarray) -> np.ndarray:
    at, size = t.words.at, t.word_sizes()
    return np.array([at[r + 1] > at[r] and size[at[r] : at[r + 1]].max() > 1000 for r in rows], bool)


def _one_word(t: Texts, rows: np.ndarray) -> np.ndarray:
    """One word makes up more than half of the text."""
    h = t.words.hashes() if len(rows) else None
    out = []
    for r in rows:
        x = h[t.words.at[r] : t.words.at[r + 1]]
        out.append(len(x) >= 10 and 2 * np.unique(x, return_counts=True)[1].max() > len(x))
    return np.array(out, bool)


#: name: what rejects a text. Bounds are wide: they are for texts that are hardly prose at all.
RULES: dict[str, Rule] = {
    "symbols": _share(_SYMBOL, most=0.15),
    "digits": _share(_DIGIT, most=0.4),
    "letters": _letters,
    "word length": _word_length,
    "long word": _long_word,
    "one word": _one_word,
}


def cascade(texts: Texts, rows: np.ndarray, order: list[str]) -> np.ndarray:
    """Which of ``rows`` no rule rejects."""
    for name in order:
        if len(rows):
            rows = rows[~RULES[name](texts, rows).astype(bool)]
    return rows


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(rule, gone, seconds)`` of each batch of texts."""
    for batch in pieces(batches):
        texts = Texts(batch.column("text"))
        rows, gone, took = np.arange(batch.num_rows), [], []
        for rule in RULES.values():
            began = time.perf_counter()
            gone.append(int(np.asarray(rule(texts, rows)).sum()))
            took.append(time.perf_counter() - began)
        yield pa.RecordBatch.from_arrays([pa.array(list(RULES)), pa.array(gone, pa.int64()), pa.array(took)], names=["rule", "gone", "seconds"])


def plan(documents: DataFrame, sample_rows: int = 400) -> list[str]:
    """Rule names by falling rejections per second on a sample; only a row per rule comes back."""
    n = documents.count()
    share = min(1.0, sample_rows / max(n, 1))
    own = [c for c in ("doc_id", "text") if c in documents.columns]
    sample = documents.where(F.pmod(F.xxhash64(F.lit("quality sample"), *own), F.lit(1 << 40)) < int(share * (1 << 40)))
    rows = sample.select(F.col("text").cast("string").alias("text")).mapInArrow(measure, "rule string, gone long, seconds double")
    rate = {r["rule"]: (r["gone"] + 0.5) / max(r["seconds"], 1e-9) for r in rows.groupBy("rule").agg(F.sum("gone").alias("gone"), F.sum("seconds").alias("seconds")).collect()}
    return sorted(RULES, key=lambda n: -rate.get(n, 0.0))


def judge_quality(documents: DataFrame, *columns: str) -> DataFrame:
    """Per row the given columns, the base measures, ``base_failed`` and ``kept``."""
    order = plan(documents)
    rows = documents.select(*columns, F.col("text").cast("string").alias("text"))

    def go(batches: Iterator[pa.RecordBatch]):
        for batch in pieces(batches):
            texts = Texts(batch.column("text"))
            base = texts.base()
            failed = (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])
            kept = np.zeros(len(failed), bool)
            kept[cascade(texts, np.flatnonzero(~failed), order)] = True
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(v.astype(np.int64)) for v in base.values()] + [pa.array(failed), pa.array(kept)],
                                             names=[*columns, *base, "base_failed", "kept"])

    more = ", ".join(f"{k} long" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return rows.mapInArrow(go, shape(rows, columns, f"{more}, base_failed boolean, kept boolean"))


def keep_good(documents: DataFrame) -> DataFrame:
    """The documents that pass base and rules; columns as given."""
    rows = documents.select(F.struct(*documents.columns).alias("_row"), "text", "doc_id") if "doc_id" in documents.columns else documents
    return judge_quality(rows, "_row").where("kept").select(*[F.col("_row")[c].alias(c) for c in documents.columns])
