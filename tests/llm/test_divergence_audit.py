import re
from collections import Counter, defaultdict

from hardwood.llm.divergence_audit import divergence_audit

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, least=30, ranks=50):
    rows = [(t or "", g or "", s or "") for t, g, s in rows]
    found, docs = defaultdict(Counter), defaultdict(Counter)
    for t, g, s in rows:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
        found[g, s].update(terms)
        docs[g].update(set(terms))
    out = set()
    for lang in docs:
        kept = [w for w, n in docs[lang].items() if n >= least]
        count = {s: [found[g, s][w] for w in kept] for g, s in found if g == lang}
        p = lambda c: [1 + 10**9 * (x + 5) // (sum(c) + 5 * len(kept)) for x in c]
        q = p([sum(x) for x in zip(*count.values())]) if kept else []
        for s, c in count.items():
            pair = [(sum(abs(a - b) for a, b in zip(p(c), p(d), strict=True)), o) for o, d in count.items() if o != s]
            term = [(a - b, w) for a, b, w, n in zip(p(c), q, kept, c, strict=True) if n and a > b]
            for part, items, most in (("pair", pair, None), ("term", term, ranks)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def test_table_in_cells_of_every_size(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.text, r.lang, r.source) for r in docs.collect()])
    got = [tuple(r) for r in divergence_audit(docs).collect()]
    assert len(got) == len(want) and set(got) == want
    small = [tuple(r) for r in divergence_audit(docs, groups=3, terms=50).collect()]
    assert len(small) == len(want) and set(small) == want


def test_nulls_ties_and_groups_without_terms(spark):
    rows = [(k, "Über über 1-two_two", "en", f"s{k % 3}") for k in range(6)] + [(9, None, None, None), (9, "", "en", None), (None, "rare " * 500, "en", "empty"), (11, "É" * 100_000, "", "x"), (11, "E" * 10, "", "x")]
    df = spark.createDataFrame([(*r, r[2], 1) for r in rows], SCHEMA + ", value string, rank int")
    got = [tuple(r) for r in divergence_audit(df, least_docs=2, groups=2, terms=1).collect()]
    want = brute([r[1:] for r in rows], least=2)
    assert len(got) == len(want) and set(got) == want
    assert {r[4] for r in got if r[0] == ""} == {0}
    assert divergence_audit(df.where("false")).collect() == []
