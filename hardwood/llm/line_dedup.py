"""Line dedup, fuzzy: MinHash of character shingles, high-recall banding, exact Jaccard, union-find.

Only DataFrame functions. Lines are the ``\\n``-separated parts of a text without white space at their
ends; blank lines take no part. Equal lines are one (by md5) before anything else.

* **Signature.** The distinct hashes of a line's character shingles lie on a ring. The next ``ROWS``
  (three, five) hashes clockwise of each of ``ANCHORS`` fixed places are MinHash values (the least distance to a place is
  a permutation's minimum), so one sort gives them all; they are real hashes only, so lines that have
  nothing in common share no band. Lines of ``FEW[0]`` words or more are sketched by the ``SKETCH``
  characters from each word on, lines of up to ``FEW[1]`` words (and so text without spaces) by all their
  shingles of ``SHINGLE`` characters, those between by both.
* **Banding.** A band is the hash of an anchor's values. With all shingles 0.8 alike about 0.7
  of those at word starts agree, and a pair misses all bands in about one case of thirty; at 0.9 in none
  of 5000. A pair of which one line has over ``FEW[1]`` words and the other under ``FEW[0]`` is missed.
* **Candidates.** Each line is tried against the smallest line of every bucket it is in (a bucket of two has
  no other pair). Members of a bucket that then still lie in different components meet the next ``NEXT`` in two
  orders by hash, and those that even then lie apart all meet each other, inside a join whose condition bounds their difference from below by parity bitmaps of all their
  shingles, larger ones for longer lines: no pair within the threshold is lost, few others come out.
* **Verification.** Jaccard of all character shingles of ``SHINGLE`` characters, exact, ``num/den`` or more.
* **Union-find** over the verified links; each component keeps its first line by ``(doc_id, place)``.

A null text has no lines. Rows with a null ``doc_id`` are kept whole and are no source for others. Unlike
texts that share a ``doc_id`` are documents of their own, in an order by hash; rows alike in id and text are one
document, so what is kept or removed holds for each. Ids may be of any orderable type. Extra columns are
ignored (kept by :func:`dedup_lines`, whatever their names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .identity import ROW, numbered
from .storage import discard, materialize

SHINGLE, SKETCH, ANCHORS = 5, 10, 8
#: Values of a band, of sketches by words and by characters (whose short shingles say less each).
ROWS = (3, 5)
#: Lines of at least so many words are sketched at word starts, of at most so many at every character.
FEW = (8, 14)
#: Places on the ring of signed 64-bit hashes.
PLACES = tuple(-(1 << 63) + k * ((1 << 64) // ANCHORS) for k in range(ANCHORS))
#: Longs and shingles of the smallest parity bitmap; each next class has twice as many of both.
LANES, CLASS = 16, 512
#: Members of a bucket that each is tried against before all are tried against all.
NEXT = 6
#: Broadcast up to so many keys (16 bytes) or bands (8 bytes); more are shuffled.
BROADCAST_KEYS = 500_000
WHITE = " \t\n\x0b\x0c\r"


def _few(df: DataFrame, count: int) -> DataFrame:
    return F.broadcast(df) if count <= BROADCAST_KEYS else df


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _hashes(strings: Column) -> Column:
    return F.array_distinct(F.transform(strings, lambda s: F.xxhash64(s)))


def shingles(line: Column) -> Column:
    """Hashes of the distinct character shingles of a line; a shorter line is its own."""
    cut = F.regexp_extract_all(line, F.lit(rf"(?s)(?=(.{{{SHINGLE}}}))"), 1)
    return F.when(F.length(line) < SHINGLE, F.array(F.xxhash64(line))).otherwise(_hashes(cut))


def sketches(lines: DataFrame, *columns: str) -> DataFrame:
    """The given columns and the bands ``b0, b1, ...`` of ``line``; a line with two sketches has a second row that is not ``main``."""
    pieces = F.regexp_extract_all("line", F.lit(rf"(?s)(?=(\S.{{0,{SKETCH - 1}}}))\S+"), 1)
    words = F.size("_pieces")
    d = lines.select(*columns, "line", pieces.alias("_pieces"))
    d = d.select(*columns, F.when(words >= FEW[0], F.sort_array(_hashes(F.col("_pieces")))).alias("_w"), F.when(words <= FEW[1], F.sort_array(shingles(F.col("line")))).alias("_c"))
    one = lambda main, s, rows: F.struct(F.lit(main).alias("main"), F.col(s).alias("s"), F.lit(rows).alias("rows"))
    both = F.when(F.col("_c").isNull(), F.array(one(True, "_w", ROWS[0]))).when(F.col("_w").isNull(), F.array(one(True, "_c", ROWS[1])))
    d = d.select(*columns, F.explode(both.otherwise(F.array(one(True, "_w", ROWS[0]), one(False, "_c", ROWS[1])))).alias("_x")).select(*columns, "_x.main", F.col("_x.s").alias("_s"), F.col("_x.rows").alias("_rows"))
    places = F.array(*[F.lit(p).cast("long") for p in PLACES])
    d = d.select(*columns, "main", "_s", "_rows", F.sort_array(F.concat("_s", places)).alias("_marked"), F.concat("_s", F.slice("_s", 1, max(ROWS) - 1)).alias("_ring"))
    # hashes below each place; plain columns are compiled, and small enough for the machine's compiler without the bands
    below = lambda k: ((F.array_position("_marked", F.lit(PLACES[k]).cast("long")) - 1 - k) % F.size("_s")).cast("int")
    d = d.select(*columns, "main", "_s", "_rows", "_ring", F.array(*[below(k) for k in range(ANCHORS)]).alias("_at"))
    # a slice is compiled too, where a function of each place would be interpreted
    whole = F.size("_s") <= F.col("_rows")
    own = lambda k: F.xxhash64(F.when(whole, F.col("_s")).otherwise(F.slice("_ring", F.get("_at", F.lit(k)) + 1, F.col("_rows"))))
    return d.select(*columns, "main", *[own(k).alias(f"b{k}") for k in range(ANCHORS)])


def _occurrences(documents: DataFrame) -> DataFrame:
    """``(doc_id, place, line, key)`` of all lines that are not blank."""
    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(_split(F.col("text").cast("string"))).alias("place", "line"))
    rows = rows.select("doc_id", "place", F.btrim("line", F.lit(WHITE)).alias("line")).where("line <> ''")
    return rows.withColumn("key", _key(F.col("line")))


def _texts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(id, node, key, line)`` of the wanted ``(id, key, doc_id)``; a line is wanted from one document. ``node`` numbers the lines."""
    wanted = materialize(wanted.groupBy("doc_id").agg(F.collect_list("key").alias("wanted")))
    keys = wanted.agg(F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()[0]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(_few(wanted, keys), "doc_id")
    rows = rows.select("wanted", F.explode(_split(F.col("text"))).alias("line")).select("wanted", F.btrim("line", F.lit(WHITE)).alias("line"))
    rows = rows.withColumn("key", _key(F.col("line"))).where(F.array_contains("wanted", F.col("key")))
    lines = materialize(rows.select(F.xxhash64("key").alias("id"), "key", "line").dropDuplicates(["key"]).withColumn("node", F.monotonically_increasing_id()))
    discard(wanted)
    return lines


def _spread(df: DataFrame) -> DataFrame:
    """Evenly over all tasks: verification costs much more than its bytes tell."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _verified(pairs: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs of ids ``(a, b)``, the nodes of those whose lines reach the threshold."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.struct("node", "line").alias("p")), "a").join(texts.select(F.col("id").alias("b"), F.struct("node", "line").alias("q")), "b")
    both = _spread(both.select("p", "q")).select(F.col("p.node").alias("a"), F.col("q.node").alias("b"), shingles(F.col("p.line")).alias("x"), shingles(F.col("q.line")).alias("y"))
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("c"), (F.size("x") + F.size("y")).alias("t"))
    return both.where(F.col("c") * den >= (F.col("t") - F.col("c")) * num).select("a", "b")


def _class(size: Column) -> Column:
    return F.greatest(F.ceil(F.log2(size / CLASS)), F.lit(0)).cast("int")


def _marks(lines: DataFrame, num: int, den: int) -> DataFrame:
    """``(id, size, class, bits)``: a parity bitmap of a line's shingles in each class in which a partner of it can be.

    Lines within the threshold have sizes that differ by a factor of den / num at most, so they meet in
    the smaller one's class.
    """
    h = _spread(lines).select("id", shingles(F.col("line")).alias("h")).withColumn("size", F.size("h"))
    classes = F.array_distinct(F.array(_class(F.ceil(F.col("size") * num / den)), _class(F.col("size"))))
    h = h.select("id", "size", "h", F.explode(classes).alias("class"))
    hit = F.transform("h", lambda x: F.struct(F.call_function("shiftrightunsigned", x, 64 - (LANES - 1).bit_length() - F.col("class")).cast("int").alias("lane"),
                                              F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int")).alias("bit")))
    none = F.transform(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(LANES), F.col("class")) - 1), lambda i: F.struct(i.alias("lane"), F.lit(0).cast("long").alias("bit")))
    rows = h.select("id", "size", "class", F.explode(F.concat(hit, none)).alias("x")).groupBy("id", "size", "class", "x.lane").agg(F.bit_xor("x.bit").alias("bits"))
    return rows.groupBy("id", "size", "class").agg(F.array_sort(F.collect_list(F.struct("lane", "bits"))).alias("b")).select("id", "size", "class", F.col("b.bits").alias("bits"))


def _near(num: int, den: int) -> Column:
    """False only if p and q differ in more shingles than the threshold lets them."""
    most = (F.col("p.size") + F.col("q.size")) * (den - num)
    apart = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    some = sum((apart(F.col("p.bits")[k], F.col("q.bits")[k]) for k in range(LANES)), F.lit(0))
    all_ = F.aggregate(F.zip_with("p.bits", "q.bits", apart), F.lit(0), lambda s, x: s + x)
    return (some * (num + den) <= most) & ((F.size("p.bits") == LANES) | (all_ * (num + den) <= most))


def _links(documents: DataFrame, distinct: DataFrame, num: int, den: int) -> DataFrame:
    """``(node, component)`` of the keys of lines that are linked with others; ``distinct`` holds the sketches of each line with ``key, main, doc_id``."""
    bands = F.array_distinct(F.array(*[f"b{k}" for k in range(ANCHORS)]))
    rows = distinct.select(F.xxhash64("key").alias("id"), F.explode(bands).alias("band"))
    buckets = materialize(rows.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("a"), F.max("id").alias("b")).where("a < b"))
    large = buckets.where("m > 2").select("band", F.col("a").alias("low"))
    listed = materialize(rows.join(_few(large, large.count()), "band").where("id > low"))
    tried = materialize(buckets.where("m = 2").select("a", "b").unionByName(listed.select(F.col("low").alias("a"), F.col("id").alias("b"))).distinct())
    discard(buckets)
    ids = tried.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = _texts(documents, distinct.where("main").select(F.xxhash64("key").alias("id"), "key", "doc_id").join(ids, "id"))
    links = materialize(_verified(tried, texts, num, den))
    discard(tried)
    found = components(links)

    # what still lies apart in a bucket, the smallest line aside, which was tried against all: first, twice, each line
    # against the next few in an order by hash, which joins large groups, then all lines against each other
    marks = None
    for turn in range(3):
        placed = texts.select("id", "node").join(found, "node", "left").select("id", F.coalesce("component", "node").alias("component"))
        members = listed.join(placed, "id").select("band", "id", "component")
        mixed = materialize(members.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("band"))
        members = materialize(members.join(mixed, "band"))
        discard(mixed)
        if members.isEmpty():
            discard(members)
            break
        if marks is None:
            marks = materialize(_marks(texts.join(members.select("id").distinct(), "id", "left_semi"), num, den))
        sets = materialize(members.join(marks, "id"))
        if turn < 2:
            own = F.struct("id", "component", "size", "bits")
            w = Window.partitionBy("band", "class").orderBy(F.xxhash64("id", F.lit(turn)), "id")
            near = sets.select(own.alias("p"), F.array(*[F.lead(own, k).over(w) for k in range(1, NEXT + 1)]).alias("next")).select("p", F.explode("next").alias("q"))
            near = near.where(F.col("q").isNotNull() & (F.col("p.component") != F.col("q.component")) & _near(num, den))
        else:
            side = lambda name: sets.select(F.col("band").alias(f"{name}_band"), F.col("class").alias(f"{name}_class"), F.struct("id", "component", "size", "bits").alias(name))
            apart = (F.col("p_band") == F.col("q_band")) & (F.col("p_class") == F.col("q_class")) & (F.col("p.id") < F.col("q.id")) & (F.col("p.component") != F.col("q.component"))
            near = side("p").join(side("q"), apart & _near(num, den))
        again = near.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b")).distinct()
        new = materialize(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(_verified(again, texts, num, den)))
        discard(found, members, sets)
        found = components(new)
        discard(new)
    if marks is not None:
        discard(marks)
    keys = texts.select("node", "key")
    named = found.join(keys, "node").select("key", F.col("component").alias("node")).join(keys.withColumnRenamed("key", "component"), "node")
    named = materialize(named.select(F.col("key").alias("node"), "component"))
    discard(texts, links, listed, found)
    return named


def removed_lines(documents: DataFrame, num: int = 8, den: int = 10) -> DataFrame:
    """``(doc_id, removed)``: sorted places of lines that another line stands for, where there are any.

    Ids are whole numbers here, and each goes with one text (see :func:`numbered`).
    """
    lines = _occurrences(documents)
    # equal lines have equal bands: plain minima of longs keep this a hash aggregation
    own = [F.min(f"b{k}").alias(f"b{k}") for k in range(ANCHORS)]
    distinct = sketches(lines, "key", "doc_id").groupBy("key", "main").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"), *own)
    distinct = materialize(distinct)
    found = _links(documents, distinct, num, den)
    several = distinct.where("main").select("key", "n", "doc_id").join(found.withColumnRenamed("node", "key"), "key", "left").where("n > 1 or component is not null")
    several = materialize(several.select("key", F.coalesce("component", "key").alias("component"), "doc_id"))
    keep = materialize(several.groupBy("component").agg(F.min("doc_id").alias("keep")))
    judged = several.select("key", "component").join(keep, "component")
    gone = lines.select("doc_id", "place", "key").join(judged, "key").groupBy("doc_id", "component", "keep").agg(F.array_sort(F.collect_set("place")).alias("places"))
    # in the document that keeps a component's line, the first place stays
    places = F.when(F.col("doc_id") == F.col("keep"), F.slice("places", 2, F.size("places"))).otherwise(F.col("places"))
    gone = gone.select("doc_id", places.alias("places")).where("size(places) > 0")
    gone = materialize(gone.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("removed")))
    discard(distinct, found, several, keep)
    return gone


def line_report(documents: DataFrame, num: int = 8, den: int = 10) -> DataFrame:
    """Per row ``(doc_id, n_lines, n_removed, removed)``; places count from 0, ``n_lines`` those not blank."""
    lines = F.filter(_split(F.coalesce(F.col("text").cast("string"), F.lit(""))), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    rows, _ = numbered(documents)
    gone = removed_lines(rows.select(F.col(ROW).alias("doc_id"), "text"), num, den).withColumnRenamed("doc_id", ROW)
    rows = rows.select("doc_id", ROW, F.size(lines).cast("long").alias("n_lines")).join(gone, ROW, "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return rows.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def dedup_lines(documents: DataFrame, num: int = 8, den: int = 10) -> DataFrame:
    """The documents without those lines; one with no line left goes. ``n_chars``, if there, follows the text."""
    rows, _ = numbered(documents)
    gone = removed_lines(rows.select(F.col(ROW).alias("doc_id"), "text"), num, den)
    places = gone.agg(F.coalesce(F.sum(F.size("removed")), F.lit(0))).first()[0]
    gone = gone.select(F.col("doc_id").alias("id"), "removed")
    rows = rows.select(F.struct(*documents.columns).alias("row"), F.col(ROW).alias("id")).join(_few(gone, places), "id", "left")
    old = F.col("row.text").cast("string")
    left = F.transform(F.array(_split(old)), lambda a: F.transform(F.array_except(F.sequence(F.lit(0), F.size(a) - 1), F.col("removed")), lambda i: a[i]))[0]
    rows = rows.select("row", F.col("removed").isNull().alias("same"), F.when(F.col("removed").isNotNull(), F.array_join(left, "\n")).alias("new"))
    rows = rows.where(F.col("same") | (F.btrim("new", F.lit(WHITE)) != ""))
    new = {"text": F.col("new"), "n_chars": F.length("new")}
    kind = lambda c: documents.schema[c].dataType
    return rows.select(*[(F.when(F.col("same"), F.col("row")[c]).otherwise(new[c].cast(kind(c))) if c in new else F.col("row")[c]).alias(c) for c in documents.columns])
