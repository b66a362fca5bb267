"""The pipeline against its parts done by brute force, on the small table and on edge cases."""

import re
from collections import Counter

import corpus_pipeline
from hardwood.llm.decontaminate import contamination
from hardwood.llm.language_id import held_out_languages

from .brute import jaccard_groups, kept_lines

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "lines", "near_copies", "decontaminate", "mixture"]
    rows = {}
    for name, stage in stages.items():
        before = docs.collect()
        after = stage(spark, docs, SF)
        docs = spark.createDataFrame(after.collect(), after.schema)
        rows[name] = before, docs.collect()
        if name != "mixture":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = rows["language"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if re.search(r"[^\W\d_]", r.text or "")}
    before, after = rows["lines"]
    want = kept_lines([(r.doc_id, r.text) for r in before])
    got = {r.doc_id: r.text for r in after}
    assert len(set(want.items()) ^ set(got.items())) <= 0.02 * len(want)  # recall of near copies is high, not full
    assert all(r.n_chars == len(r.text) for r in after if want.get(r.doc_id) != next(b.text for b in before if b.doc_id == r.doc_id))
    before, after = rows["near_copies"]
    groups = jaccard_groups([(r.doc_id, r.text) for r in before], 5, 80, 100)
    assert {r.doc_id for r in after} == set(groups.values())
    before, after = rows["decontaminate"]
    items = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text).strip().lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = lambda t: any(i in re.sub(r"[\x20\x09-\x0D]+", " ", t).lower() for i in items)
    assert not any(holds(r.text) for r in after)
    assert len(after) >= len(before) - sum(1 for r in before if any(len(set(grams(i)) & set(grams(r.text))) >= len(i) // 3 for i in items))
    before, after = rows["mixture"]
    n = Counter(r.source for r in before)
    total = sum(x**0.5 for x in n.values())
    out = Counter(r.source for r in after)
    assert {r.doc_id for r in after} <= {r.doc_id for r in before} and all(abs(out[s] - len(before) * x**0.5 / total) < 6 * (len(before) * x**0.5 / total) ** 0.5 + 3 for s, x in n.items())
    assert [r.mix_order for r in after] == sorted(r.mix_order for r in after)


def grams(text):
    t = re.sub(r"[\x20\x09-\x0D]+", " ", text or "").lower()
    return [t[i : i + 12] for i in range(len(t) - 11)]


def test_empty_table_nulls_and_extra_columns(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, row int, removed int"
    rows = [(1, "one line of plain words here\nand a second line", "en", "a", 45, 1, 1), (2, None, None, None, None, 1, 1), (None, "a text without an id but with words", "en", None, 3, 1, 1), (3, "", "en", "a", 0, 1, 1)]
    for docs in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            out = docs.collect()
            docs = spark.createDataFrame(out, docs.schema)
            assert name == "mixture" or docs.columns == [c.split()[0] for c in kind.split(", ")]
        assert {r.doc_id for r in out} <= {1, None}


def test_run_is_its_stages(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "text", "lang", "source", "n_chars", "replica", "mix_order"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert held_out_languages(docs).count() == contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == docs.count()
