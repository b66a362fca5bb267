"""Secret scans: Aho-Corasick keyword prefilter, anchored expressions near hits, embedded checksums.

One automaton over all keywords runs over each whole text (A-Z lower-cased). Only where a keyword ends
is an expression tried, anchored at the keyword's beginning, so the expressions' cost follows the hits.
Base kinds (fixed): ``assign``, ``access`` and ``hex`` (a run of hex digits has no keyword: 16 of them
are the least the automaton could ask for, so one compiled scan finds the runs). The method adds kinds
whose tokens hold their own checksum, and keeps a match only if it agrees: prefixed tokens that end in
the base-62 CRC32 of their body, and card numbers by the Luhn digit after a keyword.

Spans are code points, end exclusive; null is empty text. Each row gives a row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import pieces, shape

# Base kinds in their order, keywords and expressions.
BASE = ("assign", "access", "hex")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
# Prefixes of tokens with a CRC32 at their end, and words that announce a card number.
CHECKED_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
CARD_WORDS = ("card", "visa", "mastercard", "amex")
CARD = re.compile(r"(?:mastercard|card|visa|amex)(?:[\x20_-]?(?:number|no\.?))?[\"']?\x20*[:=#]?\x20*[\"']?((?:[0-9][\x20-]?){12,18}[0-9])(?![0-9])", re.I | re.A)


def base62_crc(body: str) -> str:
    """Six base-62 digits of the body's CRC32, as such tokens carry them."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits) if c.isdigit()]
    return len(values) >= 13 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(values)) % 10 == 0


def _assign(m: re.Match) -> tuple[int, int] | None:
    return m.span() if len(m[1]) >= 12 else None


def _access(m: re.Match) -> tuple[int, int] | None:
    return m.span() if len(m[0]) >= 18 else None


def _checked(m: re.Match) -> tuple[int, int] | None:
    return m.span() if base62_crc(m[1]) == m[2] else None


def _card(m: re.Match) -> tuple[int, int] | None:
    return m.span(1) if luhn(m[1]) else None


#: kind: (keywords, case matters, expression, what keeps a match)
RULES: dict[str, tuple[tuple[str, ...], re.Pattern, Callable]] = {
    "assign": (ASSIGN_WORDS, ASSIGN, _assign),
    "access": (("akia",), ACCESS, _access),
    "checked": (CHECKED_PREFIXES, CHECKED, _checked),
    "card": (CARD_WORDS, CARD, _card),
}


@cache
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    kinds: dict[str, list[str]] = {}
    for kind, (words, _, _) in RULES.items():
        for w in words:
            kinds.setdefault(w, []).append(kind)
    for w, k in kinds.items():
        a.add_word(w, (len(w), tuple(k)))
    a.make_automaton()
    return a


def scan(text: str) -> list[tuple[int, int, str]]:
    """All spans ``(start, end, kind)`` of a text, by start, then kind in their listed order."""
    found = []
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes.lower: A-Z only
    begins: dict[str, list[int]] = {}
    for end, (size, kinds) in _automaton().iter(low):
        for kind in kinds:
            begins.setdefault(kind, []).append(end - size + 1)
    for kind, places in begins.items():
        _, pattern, keep = RULES[kind]
        past = 0  # leftmost, not overlapping
        for at in sorted(places):
            if at >= past and (m := pattern.match(text, at)):
                past = m.end()
                if span := keep(m):
                    found.append((*span, kind))
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    order = {k: i for i, k in enumerate((*BASE, "checked", "card"))}
    return sorted(found, key=lambda x: (x[0], order[x[2]]))


def find_secrets(documents: DataFrame, *columns: str) -> DataFrame:
    """Per row the given columns and ``secrets array<struct<kind, start, end>>``."""
    rows = documents.select(*columns, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def go(batches: Iterator[pa.RecordBatch]):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in pieces(batches):
            spans = [[{"kind": k, "start": a, "end": b} for a, b, k in scan(t.as_py())] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(spans, kind)], names=[*columns, "secrets"])

    return rows.mapInArrow(go, shape(rows, columns, "secrets array<struct<kind:string,start:bigint,end:bigint>>"))


def secret_digests(documents: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)``."""
    rows = find_secrets(documents, "doc_id")
    told = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("secrets", lambda x: x["kind"].isin(*BASE))
    return rows.select("doc_id", *[count(k) for k in BASE], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"))


def redact(documents: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every span (overlaps merged) replaced by ``mark``; null texts stay null."""
    rows = documents.select(F.struct(*documents.columns).alias("_row"), "text")
    found = find_secrets(rows, "_row").withColumn("_text", F.col("_row.text").cast("string"))
    # left to right: (text so far, place reached)
    step = lambda s, x: F.struct(
        F.when(x["start"] >= s["at"], F.concat(s["out"], F.substring(F.col("_text"), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mark))).otherwise(s["out"]).alias("out"),
        F.greatest(s["at"], x["end"]).alias("at"))
    done = F.aggregate("secrets", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), step,
                       lambda s: F.concat(s["out"], F.substring(F.col("_text"), (s["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    return found.select(*[(F.when(F.col("_text").isNull(), None).otherwise(done) if c == "text" else F.col("_row")[c]).alias(c) for c in documents.columns])
