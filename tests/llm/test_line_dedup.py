import random

from hardwood.llm import line_dedup
from hardwood.llm.components import components
from hardwood.llm.line_dedup import dedup_lines, line_report

WS = " \t\n\x0b\x0c\r"


def sets(rows):
    lines = [(d, i, x.strip(WS)) for d, t in rows for i, x in enumerate((t or "").split("\n")) if x.strip(WS)]
    return lines, {x: ({x[i : i + 5] for i in range(len(x) - 4)} if len(x) >= 5 else {x}) for _, _, x in lines}


def brute(rows, num=8, den=10):
    """Removed places per document, and all links of different lines.

    Lines within the threshold share one of each other's rarest shingles (of n, the n - ceil(0.8 n) + 1 rarest).
    """
    lines, sh = sets(rows)
    often = {}
    for s in sh.values():
        for g in s:
            often[g] = often.get(g, 0) + 1
    by, rare = {}, {}
    for x, s in sh.items():
        rare[x] = sorted(s, key=lambda g: (often[g], g))[: len(s) - -(-len(s) * num // den) + 1]
        for g in rare[x]:
            by.setdefault(g, []).append(x)
    root = {x: x for x in sh}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = set()
    for x, s in sh.items():
        for y in {y for g in rare[x] for y in by[g] if x < y and num * len(s) <= den * len(sh[y]) and num * len(sh[y]) <= den * len(s)}:
            c = len(s & sh[y])
            if c * den >= num * (len(s) + len(sh[y]) - c):
                links.add((x, y))
                root[find(x)] = find(y)
    first, out = {}, {}
    for d, i, x in sorted(lines):
        if first.setdefault(find(x), (d, i)) != (d, i):
            out.setdefault(d, []).append(i)
    return out, links


def test_table_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want, links = brute(rows)
    got = {r.doc_id: r.removed for r in line_report(df).collect()}
    pairs = {(d, i) for d, x in want.items() for i in x}
    have = {(d, i) for d, x in got.items() for i in x}
    assert len(links) > 50 and len(have & pairs) >= 0.97 * len(pairs) and len(have - pairs) <= 0.01 * len(have) + 1


def test_edits_nulls_and_ties(docs, spark):
    rnd = random.Random(8)
    line = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(n))
    base = [line(40) for _ in range(6)]

    def edit(x):
        w = x.split(" ")
        w[rnd.randrange(len(w))] = "zz"
        return " ".join(w)

    texts = ["\n".join(base), None, "", " \n\t", "\n".join(edit(b) for b in base), base[2] + "  \r\nfresh line here", "ab\nab\ncd", "\n".join([line(30)] * 3) + "\n"]
    texts += [edit(base[0]) + "\n" + line(12) for _ in range(30)]
    df = docs(*texts)
    want, _ = brute(list(enumerate(texts)))
    got = {r.doc_id: r for r in line_report(df).collect()}
    assert {d: r.removed for d, r in got.items() if r.removed} == want
    assert got[1].n_lines == got[3].n_lines == 0 and got[6].n_lines == 3
    kept = {r.doc_id: r.text for r in dedup_lines(df).collect()}
    assert 4 not in kept and kept[1] is None and kept[3] == " \n\t" and kept[5] == "fresh line here" and kept[6] == "ab\ncd"
    assert kept[7].count("\n") == 1
    odd = spark.createDataFrame([(None, "q\nq", 1, 7), (3, "q\nq", 1, 3), (3, "q\nq", 1, 3)], "doc_id long, text string, removed int, n_chars int")
    assert sorted((r.doc_id or 0, r.text, r.n_chars, r.removed) for r in dedup_lines(odd).collect()) == [(0, "q\nq", 7, 1), (3, "q", 1, 1), (3, "q", 1, 1)]
    assert line_report(df.where("false")).collect() == []


def trio(seed):
    """A line with 14 words of the third, a near copy of the third, and the third."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9)))
    c = [word() for _ in range(24)]
    b = list(c)
    for _ in range(2):
        b[rnd.randrange(24)] = word()
    return [" ".join(x) for x in (c[:14] + [word() for _ in range(10)], b, c)]


def test_near_copy_as_second_choice_and_with_few_equal_anchors(docs):
    # seeds whose third line shares as many buckets of two with the first as with its near copy, and one pair with a band and two anchors in common
    texts = [x for seed in (2182, 4332, 5921, 6165) for x in trio(seed)] + trio(4040)[1:]
    want, links = brute(list(enumerate(texts)))
    assert len(links) == 5
    assert {r.doc_id: r.removed for r in line_report(docs(*texts)).collect() if r.removed} == want


def test_components_are_found_by_number(docs, monkeypatch):
    # minima of md5 keys need sorted aggregations, those of numbers do not
    texts = [x for seed in (2182, 4332) for x in trio(seed)] + trio(4040)
    want, _ = brute(list(enumerate(texts)))
    kinds = []
    monkeypatch.setattr(line_dedup, "components", lambda links: kinds.append(links.dtypes) or components(links))
    assert {r.doc_id: r.removed for r in line_report(docs(*texts)).collect() if r.removed} == want
    assert kinds and all(k == [("a", "bigint"), ("b", "bigint")] for k in kinds)
