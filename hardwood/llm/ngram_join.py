"""N-gram Jaccard join: size-aware heavy-light self-join of shingle sets, and the groups it links.

* **Sets.** Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a set holds the distinct
  n-word shingles (the whole sequence for fewer words, nothing without words) as 64-bit hashes.
  Equal sets become one class at once, so copies never meet in pairs.
* **Light sets** (up to ``boundary`` shingles): a pair reaching the threshold differs by at most
  one shingle, so each set emits itself and its subsets one smaller. An equal subset *is* the proof.
* **Heavy sets**: inverted lists are scanned. A list per single shingle would be as hot as the most
  shared passage, so the lists are keyed by the part of a set that falls in one of m hash ranges:
  a pair reaching the threshold differs in at most k shingles, hence agrees on m - k ranges. m exceeds k
  by more ranges than a set leaves empty, so a pair agrees on one that holds shingles and empty ranges,
  which unrelated sets have in common, are no keys (a set with more empty ones emits those too).
* **Boundary**: the size up to which the subsets cost fewer bytes than list rows plus verification.
* **Links.** Each set is first tried against the smallest set of the list it shares most often (one row a
  set). Only members of a list that are then still in different components are compared with each
  other, inside a join behind a bound on sizes and parity bitmaps; a bitmap has at least twice as many bits
  as its set has shingles, so the bound stays sharp for long texts. All are verified exactly.

Null or blank texts have empty sets and link with nothing. A row with a null ``doc_id`` keeps its row and
links nothing; its component is that of an equal set with an id, null if there is none. Texts of one ``doc_id``
are one node of :func:`ngram_jaccard_groups`, and each its own of :func:`keep_one`. Ids may be of any orderable
type. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .identity import ROW, numbered
from .storage import discard, materialize
from .textarrays import U, Words, list_column, mix, pieces, runs

#: Bytes of a row (key and id), and of one shingle of a set sent to be verified.
ROW_BYTES, SHINGLE_BYTES = 24, 8
#: Ranges beyond the differences: a constant and a share of all, more than sets leave empty.
SPARE, SPARE_SHARE = 3, 0.06
#: Broadcast a set of document ids up to this many (8 bytes each); larger ones are shuffled.
BROADCAST_IDS = 1_000_000
#: Longs of the smallest parity bitmap, for sets of up to CLASS shingles; each next class has twice as many of both.
LANES, CLASS = 16, 512


class Plan:
    """What follows from the threshold ``num / den``: differences allowed, boundary and levels of list keys."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        light = [n for n in range(1, 2 * den) if self.differ(n, self.largest(n)) <= 1 and self.differ(n, n) <= 1]
        top = 0
        for n in light:
            if n != top + 1 or self.subset_bytes(n) > self.list_bytes(n):
                break
            top = n
        self.boundary = top
        self.levels, size = [], top + 1
        while len(self.levels) < 99 and (not self.levels or self.levels[-1][0] < 2**31):
            size = max(size + 1, size * 4 // 3)
            self.levels.append((size, self.parts(size)))
        self.caps = np.array([x[0] for x in self.levels])

    def largest(self, n: int) -> int:
        return n * self.den // self.num

    def differ(self, a: int, b: int) -> int:
        """The most shingles in which sets of sizes a <= b may differ: a + b - 2 * least intersection."""
        return a + b - 2 * -(-(a + b) * self.num // (self.den + self.num))

    def parts(self, n: int) -> int:
        """Ranges for sets of up to n shingles."""
        return int((self.differ(n, self.largest(n)) + SPARE) / (1 - SPARE_SHARE)) + 1

    def spare(self, n: int) -> int:
        """Ranges on which a linked pair agrees, at least, of those for sets of up to n shingles."""
        return self.parts(n) - self.differ(n, self.largest(n))

    def subset_bytes(self, n: int) -> int:
        return ROW_BYTES * (1 + n * (self.largest(n - 1) >= n))

    def list_bytes(self, n: int) -> int:
        return ROW_BYTES * self.parts(n) + 2 * SHINGLE_BYTES * n

    def smallest(self, n: int) -> int:
        return -(-n * self.num // self.den)

    def keys(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the sorted set ``s``: itself if light, its subsets, and its ranges in the lists to verify."""
        n = len(s)
        own, proof, lists = [], [], []
        m = mix(s)
        if n <= self.boundary:
            own.append(np.array([m.sum(dtype=U)], U) * U(3) + U(n))
        if 1 < n <= self.boundary + 1 and self.largest(n - 1) >= n:
            proof.append((m.sum(dtype=U) - m) * U(3) + U(n - 1))
        if n > self.boundary:
            total = np.concatenate([np.zeros(1, U), np.cumsum(m, dtype=U)])
            low = max(self.smallest(n), self.boundary + 1)
            for k in range(int(np.searchsorted(self.caps, low)), int(np.searchsorted(self.caps, n)) + 1):
                parts = self.levels[k][1]
                edges = np.searchsorted((s >> U(32)) * U(parts) >> U(32), np.arange(parts + 1, dtype=U))
                key = mix((total[edges[1:]] - total[edges[:-1]]) ^ mix(np.arange(parts, dtype=U) + U(k << 40)))
                full = edges[1:] > edges[:-1]
                lists.append(key if (~full).sum() >= self.spare(self.levels[k][0]) else key[full])
        return tuple(np.concatenate(x) if x else np.empty(0, U) for x in (own, proof, lists))


def _class(n: int) -> int:
    """The class of bitmaps for sets of n shingles."""
    return max(0, (n - 1).bit_length() - CLASS.bit_length() + 1)


def document_sets(batches: Iterator[pa.RecordBatch], n: int, whole: bool = False) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The sorted shingle hashes of each text, batches taken in pieces or ``whole``."""
    for batch in batches if whole else pieces(batches):
        words = Words(batch.column("text"), lower=True)
        h = words.hashes()
        grams = runs(h, n)
        sets = []
        for a, b in zip(words.at[:-1], words.at[1:], strict=True):
            if b - a >= n:
                sets.append(np.unique(grams[a : b - n + 1]))
            else:
                sets.append(mix(runs(h[a:b], int(b - a)) + U(b - a)) if b > a else np.empty(0, U))
        yield batch, sets


def _profile(documents: DataFrame, n: int, plan: Plan) -> DataFrame:
    """Per row: size, two digests of the set, a parity bitmap and the keys."""

    def go(batches):
        for batch, sets in document_sets(batches, n):
            own, proof, lists, d1, d2, bits = [], [], [], [], [], []
            for s in sets:
                o, p, q = plan.keys(s)
                own.append(o)
                proof.append(p)
                lists.append(q)
                d1.append(mix(s).sum(dtype=U))
                d2.append(mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U))
                # the word by the leading bits, the place in it by the last: two neighbouring words are one of the class below
                size = LANES << _class(len(s))
                at = (s >> U(65 - size.bit_length())) * U(64) + (s & U(63))
                bits.append(np.packbits(np.bincount(at.astype(np.int64), minlength=64 * size).astype(np.uint8) & 1).view(np.int64))
            ends = lambda x: np.concatenate([[0], np.cumsum([len(y) for y in x])])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(np.array(d1, U).view(np.int64)), pa.array(np.array(d2, U).view(np.int64)),
                list_column(np.concatenate(bits), ends(bits)),
                list_column(np.concatenate(own), ends(own)), list_column(np.concatenate(proof), ends(proof)), list_column(np.concatenate(lists), ends(lists)),
            ], names=["doc_id", "n", "d1", "d2", "bits", "own", "proof", "lists"])

    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        go, "doc_id long, n long, d1 long, d2 long, bits array<long>, own array<long>, proof array<long>, lists array<long>")


def _verified(documents: DataFrame, pairs: DataFrame, n: int, plan: Plan) -> DataFrame:
    """The pairs ``(a, b)`` that reach the threshold, by exact intersection; written.

    The two texts of a pair meet in a row, which is smaller than their sets, and the sets are made there.
    """

    def go(batches):
        for batch in batches:
            for part in pieces(iter([batch]), "x"):
                hit = []
                left, right = (next(document_sets(iter([part.select([c]).rename_columns(["text"])]), n, whole=True))[1] for c in ("x", "y"))
                for x, y in zip(left, right, strict=True):
                    c = len(np.intersect1d(x, y, assume_unique=True))
                    hit.append(c * plan.den >= (len(x) + len(y) - c) * plan.num)
                yield part.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    pairs = materialize(pairs)
    bounded = pairs.count() <= BROADCAST_IDS
    small = F.broadcast if bounded else (lambda df: df)
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    side = lambda k, t: texts.select(F.col("doc_id").alias(k), F.col("text").alias(t))
    right = side("b", "y").join(small(pairs.select("b").distinct()), "b", "left_semi")
    near = materialize(side("a", "x").join(small(pairs), "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(go, "a long, b long").distinct())
    discard(pairs)
    return near


def _folded(bits: Column) -> Column:
    """A bitmap in the next smaller class."""
    return F.transform(F.sequence(F.lit(0), (F.size(bits) / 2).cast("int") - 1), lambda i: F.get(bits, 2 * i).bitwiseXOR(F.get(bits, 2 * i + 1)))


def _near(p: Column, q: Column, x: Column, y: Column, plan: Plan) -> Column:
    """Whether sets p and q with bitmaps x and y of one class can reach the threshold (never wrong when it says no)."""
    total = p["n"] + q["n"]
    least = F.ceil(total * plan.num / (plan.num + plan.den) - F.lit(1e-6)).cast("long")
    apart = lambda a, b: F.bit_count(a.bitwiseXOR(b))
    some = sum((apart(x[k], y[k]) for k in range(LANES)), F.lit(0))
    all_ = F.aggregate(F.zip_with(x, y, apart), F.lit(0), lambda s, v: s + v)
    return (least <= F.least(p["n"], q["n"])) & (some <= total - 2 * least) & ((F.size(x) == LANES) | (all_ <= total - 2 * least))


def _near_pairs(pairs: DataFrame, slim: DataFrame, plan: Plan) -> DataFrame:
    """The pairs ``(a, b)`` that sizes and bitmaps do not rule out."""
    side = lambda c: slim.select(F.col("doc_id").alias(c), F.struct("n", "bits").alias(f"_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    p, q = F.col("_a"), F.col("_b")
    other = lambda v, w: F.when(F.size(v["bits"]) > F.size(w["bits"]), _folded(v["bits"])).otherwise(v["bits"])
    same = both.select("a", "b", p.alias("p"), q.alias("q"), other(p, q).alias("x"), other(q, p).alias("y")).where("size(x) = size(y)")
    return same.where(_near(F.col("p"), F.col("q"), F.col("x"), F.col("y"), plan)).select("a", "b")


def _classes(rows: DataFrame, plan: Plan) -> DataFrame:
    """Each row with its bitmap in every class in which a partner of it can be: its own, and the one below if smaller partners lie there."""
    lower = (F.ceil(F.col("n") * plan.num / plan.den) <= F.size("bits") * (CLASS // LANES // 2)) & (F.size("bits") > LANES)
    return rows.withColumn("bits", F.explode(F.when(lower, F.array("bits", _folded(F.col("bits")))).otherwise(F.array("bits"))))


def _groups(documents: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row of documents whose ids go with one text each; a table."""
    plan = Plan(num, den)
    profile = materialize(_profile(documents, n, plan))
    classes = materialize(profile.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")))
    member = materialize(profile.select("doc_id", "n", "d1", "d2").join(classes, ["n", "d1", "d2"], "left").select(
        "doc_id", "n", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep")))
    discard(classes)
    copies = member.where("rep <> doc_id").select("doc_id").distinct()
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    heads = profile.where("doc_id is not null").join(copies, "doc_id", "left_anti")

    proven = heads.select("doc_id", F.explode("proof").alias("key")).join(
        heads.select(F.col("doc_id").alias("other"), F.explode("own").alias("key")), "key")
    proven = proven.select(F.col("other").alias("a"), F.col("doc_id").alias("b"))
    # one sort of (key, doc_id) rows; lists of one document end here
    w = Window.partitionBy("key").orderBy("doc_id")
    rows = heads.select("doc_id", F.explode("lists").alias("key"))
    rows = rows.select("key", "doc_id", F.first("doc_id").over(w).alias("low"), F.lead("doc_id").over(w).alias("next"))
    listed = materialize(rows.where("low < doc_id or next > doc_id").select("key", "doc_id", "low"))
    # each set against the smallest one with which it shares most lists
    star = listed.where("doc_id > low").groupBy("doc_id", "low").agg(F.count(F.lit(1)).alias("m")).groupBy("doc_id").agg(F.max_by("low", F.struct("m", "low")).alias("a"))
    slim = materialize(heads.select("doc_id", "n", "d1", "d2", "bits").dropDuplicates(["doc_id", "n", "d1", "d2"]).drop("d1", "d2"))
    proven = materialize(proven.distinct())
    discard(profile)
    near = _verified(documents, _near_pairs(star.select("a", F.col("doc_id").alias("b")), slim, plan), n, plan)
    links = materialize(proven.unionByName(near))
    discard(proven, near)
    found = components(links)

    of = listed.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = materialize(of.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key"))
    open_ = materialize(of.join(mixed, "key"))
    discard(listed, mixed)
    if not open_.isEmpty():
        sides = _classes(open_.join(slim, "doc_id"), plan)
        side = lambda k: sides.select(F.col("key").alias(f"{k}_key"), F.size("bits").alias(f"{k}_class"), F.struct("doc_id", "component", "n").alias(k), F.col("bits").alias(f"{k}_bits"))
        p, q = F.col("p"), F.col("q")
        meet = (F.col("p_key") == F.col("q_key")) & (F.col("p_class") == F.col("q_class")) & (p["doc_id"] < q["doc_id"]) & (p["component"] != q["component"])
        again = side("p").join(side("q"), meet & _near(p, q, F.col("p_bits"), F.col("q_bits"), plan))
        more = _verified(documents, again.select(p["doc_id"].alias("a"), q["doc_id"].alias("b")).distinct(), n, plan)
        both = materialize(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
        discard(found, more)
        found = components(both)
        discard(both)
    discard(links, open_, slim)
    groups = materialize(member.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")))
    discard(member, found)
    return groups


def ngram_jaccard_groups(documents: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row; links are ``den * intersection >= num * union``."""
    rows, names = numbered(documents)
    groups = _groups(rows.select(F.col(ROW).alias("doc_id"), "text"), n, num, den)
    if names is None:
        return groups
    # texts of one id are one document: their components are one
    of = groups.join(names.select(F.col("__id"), F.col(ROW).alias("doc_id")), "doc_id", "left")
    ends = of.where("__id is not null").groupBy("__id").agg(F.min("component_id").alias("x"), F.max("component_id").alias("y")).where("x < y").select("__id", "x")
    found = components(of.join(ends, "__id").select(F.col("x").alias("a"), F.col("component_id").alias("b")))
    of = of.join(found.withColumnRenamed("node", "component_id"), "component_id", "left").withColumn("c", F.coalesce("component", "component_id"))
    of = of.join(names.select(F.col("__id").alias("first"), F.col(ROW).alias("c")), "c", "left")
    out = materialize(of.select(F.col("__id").alias("doc_id"), "n_shingles", F.col("first").alias("component_id")))
    discard(groups, found, names)
    return out


def keep_one(documents: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """The documents but for those that a group's smallest ``doc_id`` stands for; columns as given.

    Unlike texts of one ``doc_id`` are judged each by itself, so that none goes without one that stands for it.
    """
    rows, _ = numbered(documents)
    gone = _groups(rows.select(F.col(ROW).alias("doc_id"), "text"), n, num, den).where("doc_id <> component_id").select(F.col("doc_id").alias(ROW)).distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone  # texts stay where they are while the ids are few
    return rows.join(gone, ROW, "left_anti").select(*documents.columns)
