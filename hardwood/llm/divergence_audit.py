"""Source divergence audit: how unlike the sources of a language are in the terms they use.

Per language the audit fills a cube (group block, group block, term block). A group is a (lang, source); its
slice of a term block holds the shares of that block's terms. Each slice is copied to the cells of its row and
column of the cube, a task owns a cell and sums ``|p - q|`` of its pairs of groups over its terms, and a sum over
the term axis gives the pair's divergence.

* A cell holds at most ``2 * groups`` slices of about ``terms`` numbers, whatever the corpus holds.
* Counts are combined in the tasks that read the texts before anything moves, so a source with a third of all
  rows, or a term in every document, is one row a task.
* A slice is moved once for each group block of its language.

All arithmetic is of integers. Null text, lang and source are read as ``''``; a group without terms takes part
with zero counts; a language without kept terms gives pairs of value 0; repeated rows are documents of their
own; ties rank by the item's UTF-8 bytes; no documents give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, materialize
from .textarrays import pieces

#: ASCII letters lower-cased, bytes beyond ASCII as they are, all else a space.
_TERM_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_COUNTS = "lang string, source string, term binary, n long, docs long"


def term_counts(documents: DataFrame, held: int = 200_000) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of each term in each group.

    Each group also has one row of a null term and zeros. ``held`` bounds the terms that a task holds before it
    hands its counts on (one document's distinct terms may exceed it).
    """

    def count(batches):
        n, docs = defaultdict(Counter), defaultdict(Counter)

        def rows():
            keys = [(g, t) for g, found in n.items() for t in (None, *found)]
            out = pa.RecordBatch.from_arrays([
                pa.array([g[0] for g, _ in keys], pa.string()), pa.array([g[1] for g, _ in keys], pa.string()), pa.array([t for _, t in keys], pa.binary()),
                pa.array([n[g][t] if t is not None else 0 for g, t in keys], pa.int64()), pa.array([docs[g][t] if t is not None else 0 for g, t in keys], pa.int64())],
                names=["lang", "source", "term", "n", "docs"])
            n.clear()
            docs.clear()
            return out

        for batch in pieces(batches):
            lang, source = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for k, text in enumerate(batch.column("text").cast(pa.binary())):
                words = text.as_buffer().to_pybytes().translate(_TERM_BYTES).split()
                n[lang[k], source[k]].update(words)
                docs[lang[k], source[k]].update(set(words))
            if sum(map(len, n.values())) > held:
                yield rows()
        yield rows()

    read = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return (read.mapInArrow(count, _COUNTS).groupBy("lang", "source", F.col("term").cast("string").alias("term"))
            .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def _share(count: str, total: str, terms: str) -> F.Column:
    """The smoothed share in billionths, exact beyond 64 bits."""
    return F.expr(f"1 + cast(1000000000 as decimal(38,0)) * ({count} + 5) div cast({total} + 5 * {terms} as decimal(38,0))")


def _own_cell(key: tuple, slices: pd.DataFrame) -> pd.DataFrame:
    """Partial divergences of a cell's pairs: groups of block ``bi`` with later ones of block ``bj``."""
    lang, bi, bj, _ = key

    def dense(block):
        of = slices[slices["block"] == block].sort_values("gid")
        width = int(of["width"].iloc[0])
        out = np.repeat(of["zero"].to_numpy(np.int64)[:, None], width, 1)
        for row, (at, p) in enumerate(zip(of["at"], of["p"], strict=True)):
            out[row, np.asarray(at, np.int64)] = np.asarray(p, np.int64)
        return of["gid"].to_numpy(), out

    a, left = dense(bi)
    b, right = (a, left) if bi == bj else dense(bj)
    found = []
    for row in range(len(a)):
        later = np.flatnonzero(b > a[row])
        found.append(pd.DataFrame({"ga": a[row], "gb": b[later], "part": np.abs(right[later] - left[row]).sum(1)}))
    return pd.concat(found).assign(lang=lang)[["lang", "ga", "gb", "part"]]


def divergence_audit(documents: DataFrame, least_docs: int = 30, ranks: int = 50, groups: int = 32, terms: int = 2048) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: each source's divergence from every other, and its leading terms.

    A language keeps the terms of at least ``least_docs`` of its documents. Part ``pair``: every other source of
    the language and the summed ``|p - q|``. Part ``term``: the group's terms above the language's share, to
    rank ``ranks``. ``groups`` and ``terms`` are the edges of a cell.
    """
    counts = materialize(term_counts(documents))
    vocabulary = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs)
    sizes = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    dealt = vocabulary.join(sizes, "lang").withColumn("bt", F.expr(f"pmod(xxhash64(term), cast(ceil(v / {terms}) as bigint))"))
    kept = materialize(dealt.repartition("lang", "bt").select("lang", "term", "lang_n", "v", "lang_total", "bt", (F.row_number().over(Window.partitionBy("lang", "bt").orderBy("term")) - 1).alias("at")))
    there = materialize(counts.where("term is not null").join(kept, ["lang", "term"]))
    totals = there.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.max("v").alias("v"), F.max("lang_total").alias("lang_total"))
    group = (counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
             .select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "lang_total")],
                     (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("gid"))
             .withColumn("zero", F.when(F.col("v") > 0, _share("0", "total", "greatest(v, 1)")).otherwise(0))
             .withColumn("block", F.expr(f"gid div {groups}")).withColumn("blocks", F.expr(f"1 + max(gid) over (partition by lang) div {groups}")))
    group = materialize(group)
    there = there.drop("v", "lang_total").join(group.select("lang", "source", "gid", "total", "v", "lang_total"), ["lang", "source"]).withColumn("p", _share("n", "total", "v"))
    leading = there.withColumn("value", F.col("p") - _share("lang_n", "lang_total", "v")).where("value > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")

    slices = there.groupBy("lang", "gid", "bt").agg(F.collect_list(F.struct("at", "p")).alias("held"))
    width = kept.groupBy("lang", "bt").agg(F.count(F.lit(1)).cast("int").alias("width"))
    cells = (group.select("lang", "gid", "zero", "block", "blocks", F.explode(F.expr(f"sequence(0L, greatest(cast(ceil(v / {terms}) as bigint), 1L) - 1)")).alias("bt"))
             .join(width, ["lang", "bt"], "left").join(slices, ["lang", "gid", "bt"], "left")
             .select("lang", "gid", "zero", "block", "bt", F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("held.at", F.array().cast("array<int>")).alias("at"),
                     F.coalesce("held.p", F.array().cast("array<bigint>")).alias("p"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other"))
             .withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("other"))
    parts = cells.groupBy("lang", "bi", "bj", "bt").applyInPandas(_own_cell, "lang string, ga long, gb long, part long")
    name = group.select("lang", "gid", "source")
    pairs = (parts.groupBy("lang", "ga", "gb").agg(F.sum("part").alias("value"))
             .join(name.select("lang", F.col("gid").alias("ga"), F.col("source").alias("a")), ["lang", "ga"]).join(name.select("lang", F.col("gid").alias("gb"), F.col("source").alias("b")), ["lang", "gb"])
             .select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
             .select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = materialize(pairs.withColumn("rank", rank).unionByName(leading.withColumn("rank", rank).where(F.col("rank") <= ranks)))
    discard(counts, kept, group)
    return out


#: The audit in SQL, with the default parameters.
SQL = r"""
WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r FROM documents),
t AS (SELECT lang, source, r, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
size AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
cube AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.lang_n, s.v, s.lang_total, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
         FROM grp g JOIN kept k USING (lang) JOIN size s USING (lang) LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS p, 1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v) AS q FROM cube),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, (SELECT coalesce(sum(abs(x.p - y.p)), 0) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
         WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
