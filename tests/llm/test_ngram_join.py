import random
import re

from hardwood.llm.ngram_join import Plan, keep_one, ngram_jaccard_groups


def brute(rows, n=3, num=90, den=100):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            c = len(x & y)
            if c and c * den >= num * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {(d, len(sets[d]), find(d)) for d in ids}


def result(df):
    return {tuple(r) for r in ngram_jaccard_groups(df).collect()}


def test_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_chains_of_edits_at_every_size(docs):
    rnd = random.Random(5)
    texts = []
    for size in (1, 2, 3, 5, 11, 12, 13, 14, 20, 21, 22, 30, 60, 200, 900):
        w = [f"w{rnd.randrange(10**6)}" for _ in range(size)]
        for _ in range(12):
            texts.append(" ".join(w))
            w = list(w)
            for _ in range(max(1, size // 60)):
                k = rnd.randrange(len(w) + 1)
                w[k : k + rnd.randrange(2)] = [f"x{rnd.randrange(10**6)}"] * rnd.randrange(2)
            w = w or ["z"]
    df = docs(*texts)
    got = result(df)
    assert got == brute(list(enumerate(texts)))
    kept = {r.doc_id for r in keep_one(df).collect()}
    assert kept == {c for _, _, c in got}


def test_other_threshold(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {tuple(r) for r in ngram_jaccard_groups(df, 5, 80, 100).collect()}
    assert got == brute([(r.doc_id, r.text) for r in df.collect()], 5, 80, 100)


def test_nulls_blanks_repeats_and_extra_columns(spark):
    rows = [(1, None, 1), (2, "", 1), (3, " \n\t", 1), (4, "A b\x0bc d", 1), (5, "a B c\fd", 1), (None, "a b c d", 1), (6, "solo", 2), (6, "solo", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumnRenamed("n", "component_id")
    got = sorted(map(tuple, ngram_jaccard_groups(df).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 2, 4), (5, 2, 4), (None, 2, 4), (6, 1, 6), (6, 1, 6)], key=str)
    assert ngram_jaccard_groups(df.where("false")).collect() == []


def test_boundary_follows_cost():
    p = Plan(90, 100)
    assert 8 < p.boundary < 19 and p.subset_bytes(p.boundary) <= p.list_bytes(p.boundary)
    assert p.differ(19, 19) == 2 and p.differ(9, 10) == 1


def test_links_across_the_sizes_at_which_bitmaps_grow(spark):
    words = [f"w{i}" for i in range(1060)]
    rows = [(1, " ".join(words[:500])), (2, " ".join(words[:530])), (3, " ".join(words[20:1030])), (4, " ".join(words[20:1060]))]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) == {(1, 498, 1), (2, 528, 1), (3, 1008, 3), (4, 1038, 3)}
