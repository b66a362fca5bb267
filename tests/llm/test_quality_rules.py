import re
from collections import Counter

import numpy as np
import pyarrow as pa

from hardwood.llm.quality_rules import RULES, Texts, cascade, judge_quality, keep_good


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def check(df):
    text = {r.doc_id: r.text for r in df.collect()}
    rows = judge_quality(df, "doc_id").collect()
    assert len(rows) == len(text)
    for r in rows:
        b = brute(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b, r.doc_id
        assert r.base_failed == (b[0] < 10 or 100 * b[4] > 20 * b[0]) and not (r.base_failed and r.kept)
    return rows


def test_table_against_brute_force(spark):
    rows = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert sum(r.kept for r in rows) > 0.9 * sum(not r.base_failed for r in rows)


def test_edges(docs, spark):
    df = docs(None, "", "a b c d e a b c d e", "é x\n\né x\n \n \né x", "# " * 40 + "word " * 3, "x" * 100000, " ".join(f"clean{i} words" for i in range(40)), "a" * 4 + " b c")
    rows = check(df)
    assert {r.doc_id for r in rows if r.kept} == {6} == {r.doc_id for r in keep_good(df).collect()}
    assert judge_quality(df.where("false"), "doc_id").collect() == []


def test_order_never_changes_the_verdict():
    t = Texts(pa.array(["good words here " * 9, "1234 " * 30, "$$ " * 30, "w" * 2000, "the " * 20]))
    want = cascade(t, np.arange(5), list(RULES)).tolist()
    assert want == [0] and all(cascade(t, np.arange(5), list(RULES)[k:] + list(RULES)[:k]).tolist() == want for k in range(len(RULES)))


def test_clean_texts_of_other_scripts():
    hindi = "आज सुबह बाजार में बहुत भीड़ थी और लोग ताजे फल तथा सब्जियां खरीद रहे थे"
    korean = "오늘 아침 시장에는 사람이 매우 많았고 모두 신선한 과일과 채소를 사려고 줄을 서서 기다리고 있었다"
    long = " ".join(["대한민국헌법재판소결정문"] + [f"국제연합교육과학문화기구{k}" for k in range(11)])  # words of 12 to 14 characters, over 36 bytes
    longest = "한" * 900 + " " + hindi * 20
    bad = ["한" * 1001 + " " + hindi * 20, "한글" + "7" * 3 + " " + "7 8 9 " * 9, "글# $ % " * 12]
    t = Texts(pa.array([hindi, korean, long, longest, *bad]))
    assert cascade(t, np.arange(7), list(RULES)).tolist() == [0, 1, 2, 3]


def test_other_scripts_are_kept(docs):
    texts = ["दिल्ली में कल शाम से तेज बारिश हो रही है और सड़कों पर पानी भर गया है", "어제 저녁부터 서울에는 비가 많이 내렸고 도로마다 물이 차서 차들이 아주 천천히 움직였다", "7 " * 30]
    assert [r.doc_id for r in keep_good(docs(*texts)).orderBy("doc_id").collect()] == [0, 1]
