import random

from hardwood.llm.decontaminate import Items, contamination, drop_contaminated


def plain(t):
    return " ".join((t or "").lower().split()).encode()


def least(p, t):
    """Fewest edits of all of p against some part of t."""
    d = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        new = [i + 1]
        for j, x in enumerate(t):
            new.append(min(d[j] + (c != x), d[j + 1] + 1, new[j] + 1))
        d = new
    return min(d)


def brute(rows, items):
    index = Items(items)
    out = {}
    for d, t in rows:
        out[d] = {}
        for k, (i, text) in enumerate(items):
            p = plain(text)
            if p and (e := least(p, plain(t))) <= index.edits[k]:
                out[d][i] = e
    return out


def test_edited_items_against_brute_force(spark):
    rnd = random.Random(4)
    text = lambda n: " ".join("".join(rnd.choice("etaoinsh") for _ in range(rnd.randrange(1, 8))) for _ in range(n))
    items = [(1, text(30)), (2, text(12)), (3, "Ab c"), (4, None), (5, " \n"), (6, text(3)), (7, "é" + text(20)), (8, "la " * 20)]
    rows = []
    for d in range(60):
        p = list(rnd.choice(items[:2] + items[5:])[1])
        for _ in range(rnd.randrange(0, 12)):
            k = rnd.randrange(len(p))
            p[k : k + rnd.randrange(2)] = rnd.choice(["x", "", "yy", " "])
        rows.append((d, text(rnd.randrange(0, 15)) + " " + "".join(p).replace(" ", rnd.choice([" ", "\n "])) + " " + text(rnd.randrange(0, 15))))
    rows += [(60, None), (61, ""), (62, "xx AB\t\tC yy"), (63, "la " * 300), (64, items[0][1].upper())]
    df = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, found string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items)
    got = {r.doc_id: r for r in contamination(df, bench).collect()}
    assert {d: sorted(x) for d, x in want.items()} == {d: r.item_ids for d, r in got.items()}
    assert all(r.least_edits == min(want[d].values(), default=None) for d, r in got.items())
    assert sum(r.contaminated for r in got.values()) > 20
    assert {r.doc_id for r in drop_contaminated(df, bench).collect()} == {d for d, x in want.items() if not x}
    assert drop_contaminated(df, bench.where("false")).count() == len(rows)
    assert contamination(df.where("false"), bench).collect() == []


def test_whole_items_in_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = {r.item_id: plain(r.text) for r in bench.collect()}
    got = {r.doc_id: set(r.item_ids) for r in contamination(df, bench).collect()}
    hits = 0
    for r in df.collect():
        exact = {i for i, p in items.items() if p in plain(r.text)}
        hits += len(exact)
        assert exact <= got[r.doc_id] and (exact or not got[r.doc_id])
    assert hits > 5
