import hashlib
import random
import re

from hardwood.llm.substring_dedup import cut_repeats, substring_digests


def brute(rows, length=50):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - length + 1):
            first.setdefault(tuple(words[d][i : i + length]), d)
    out = set()
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.add((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {tuple(r) for r in substring_digests(df).collect()}
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])
    assert any(r[2] for r in got)


def test_passages_nulls_and_repeats_within_a_text(docs, spark):
    rnd = random.Random(2)
    word = lambda n: [f"wé{rnd.randrange(10**6)}" for _ in range(n)]
    p, q = word(60), word(49)
    texts = [None, "", " ".join(p), " ".join(word(30) + p + word(5) + p), "\n".join(q + word(3)), " \t ".join(q + word(9)),
             " ".join(p[:55] + word(1) + p[:52]), " ".join(["a"] * 70), " ".join(["a"] * 51), "x" * 5000 + " y"]
    df = docs(*texts)
    got = {tuple(r) for r in substring_digests(df).collect()}
    assert got == brute(list(enumerate(texts)))
    assert {r.doc_id: r.text for r in cut_repeats(df).collect()}[8] == ""
    assert substring_digests(df.where("false")).collect() == []
    odd = spark.createDataFrame([(None, texts[2]), (1, texts[2]), (1, texts[2])], "doc_id long, text string")
    assert sorted(r.n_removed for r in substring_digests(odd).collect()) == [0, 0, 0]
