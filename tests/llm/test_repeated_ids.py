"""Ids that repeat with other texts, and ids that are no numbers, against brute force by row."""

import hashlib
import random
import re

from hardwood.llm.line_dedup import dedup_lines, line_report
from hardwood.llm.ngram_join import keep_one, ngram_jaccard_groups
from hardwood.llm.substring_dedup import cut_repeats, substring_digests

KIND = "doc_id long, text string"


def words(rnd, n):
    return " ".join(f"w{rnd.randrange(10**9)}" for _ in range(n))


def cut(rows, length=50):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = {j for i in range(len(w) - length + 1) if first[tuple(w[i : i + length])] < d for j in range(i, i + length)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out)


def groups(rows, n, num, den):
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append((d, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())))
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if (c := len(x & y)) and c * den >= num * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((d, len(x), find(d)) for d, x in sets)


def test_repeats_are_cut_from_their_own_text(spark):
    rnd = random.Random(1)
    p = words(rnd, 60)
    rows = [(1, p + " " + words(rnd, 20)), (5, words(rnd, 100) + " " + p), (5, "short text here"), (5, words(rnd, 70)), (6, p + " " + words(rnd, 120)), (6, words(rnd, 120)), (6, p), (6, p), (None, p)]
    got = sorted(tuple(r) for r in substring_digests(spark.createDataFrame(rows, KIND)).collect() if r.doc_id is not None)
    assert got == cut([r for r in rows if r[0] is not None])
    assert sum(r[2] for r in got) == 60 * 4
    named = spark.createDataFrame([(f"d{d}", t) for d, t in rows if d], "doc_id string, `a-b c` string").withColumnRenamed("a-b c", "text").selectExpr("*", "1 as `a-b c`")
    assert sorted((int(r.doc_id[1:]), *r[1:]) for r in substring_digests(named).collect()) == got
    kept = cut_repeats(named)
    assert kept.columns == named.columns and sorted(len(r.text.split()) for r in kept.collect()) == sorted(n - m for _, n, m, _ in got)


def test_links_of_every_text_of_an_id(spark):
    rnd = random.Random(2)
    a, b = words(rnd, 150), words(rnd, 150)
    near = " ".join(b.split()[:149]) + " end"
    rows = [(1, near), (3, a), (5, a), (5, b), (7, b), (9, words(rnd, 40)), (9, words(rnd, 30)), (9, ""), (2, ""), (11, "x"), (11, None)]
    got = sorted(tuple(r) for r in ngram_jaccard_groups(spark.createDataFrame(rows, KIND)).collect())
    assert got == groups(rows, 3, 90, 100)
    assert {r[2] for r in got if r[0] in (1, 3, 5, 7)} == {1}
    named = spark.createDataFrame([(f"d{d:02}", t) for d, t in rows], "doc_id string, text string")
    assert sorted((int(r[0][1:]), r[1], int(r[2][1:])) for r in ngram_jaccard_groups(named).collect()) == got
    kept = sorted((d, t) for d, t in keep_one(spark.createDataFrame(rows, KIND)).collect() if t)
    assert kept == sorted([(1, near), (3, a), (9, rows[5][1]), (9, rows[6][1]), (11, "x")])


def test_lines_go_only_from_the_row_that_has_them(spark):
    rnd = random.Random(3)
    line = words(rnd, 12)
    rows = [(1, line), (2, "unique line\nsomething else"), (2, line + "\nother tail"), (2, line + "\nother tail"), (4, words(rnd, 9) + "\nsomething else"), (4, line), (None, line)]
    out = sorted((r.doc_id or 0, r.text) for r in dedup_lines(spark.createDataFrame(rows, KIND)).collect())
    assert out == sorted([(1, line), (2, "unique line\nsomething else"), (2, "other tail"), (2, "other tail"), (4, rows[4][1].split("\n")[0]), (0, line)])
    named = spark.createDataFrame([(d and f"d{d}", t) for d, t in rows], "doc_id string, text string")
    report = line_report(named).collect()
    assert sorted((r.doc_id or "", r.n_removed) for r in report) == [("", 0), ("d1", 0), ("d2", 0), ("d2", 1), ("d2", 1), ("d4", 1), ("d4", 1)]


def test_columns_of_any_name_go_through_every_filter(spark):
    from pyspark.sql import functions as F

    import corpus_pipeline
    from hardwood.llm.kneser_ney import score, train
    from hardwood.llm.quality_rules import keep_good
    from hardwood.llm.secret_scan import redact
    from hardwood.llm.url_filter import keep_allowed

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("a-b c", F.col("n_chars")).withColumn("x.y`z", F.lit("é")).where("doc_id < 60")
    quoted = [c for c in docs.columns if c not in ("x.y`z",)]
    docs = docs.select(*quoted)
    for f in (keep_good, redact, keep_one, dedup_lines, cut_repeats):
        assert f(docs).columns == docs.columns and f(docs).count() > 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns, name
    assert score(docs, train(docs, 2), "a-b c").columns[0] == "a-b c"
    pages = spark.createDataFrame([(None, "http://x.com/en/1", "", 1), (None, "http://y.de/ok", "", 1), (1, "http://a.com/en/2", None, 1), (2, None, "", 1)], "page_id long, url string, html string, `a-b c` int")
    assert sorted(str(r.url) for r in keep_allowed(pages).collect()) == ["None", "http://y.de/ok"]


def test_signs_that_are_no_letters(spark):
    from hardwood.llm.quality_rules import judge_quality

    clean = "यह एक साफ हिंदी वाक्य है जिसमें कई अलग अलग शब्द लिखे गए हैं ताकि जाँच पूरी हो सके"
    odd = " ".join(chr(0x1F600 + k) + chr(0x1F640 + k) for k in range(14))
    got = {r.doc_id: r.kept for r in judge_quality(spark.createDataFrame([(1, clean), (2, odd), (3, "這是 一個 乾淨的 句子 裡面有 很多 不同的 詞語 沒有 符號 而且 足夠 長度")], KIND), "doc_id").collect()}
    assert got == {1: True, 2: False, 3: True}
