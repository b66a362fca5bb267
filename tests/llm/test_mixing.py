import math
from collections import Counter

from hardwood.llm.mixing import mix_sources, quantile
from pyspark.sql import functions as F


def test_quantile(spark):
    for mean in (0.05, 1.0, 7.5, 900.0):
        p = [math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) for k in range(int(mean + 10 * mean**0.5 + 21))]
        cdf = [sum(p[: k + 1]) for k in range(len(p))]
        us = [0.0, 0.001, 0.2, 0.5, 0.77, 0.99, 0.999999]
        got = [r.k for r in spark.createDataFrame([(u,) for u in us], "u double").select(quantile(F.col("u"), F.lit(mean)).alias("k")).collect()]
        assert got == [next(k for k, c in enumerate(cdf) if c > u) for u in us]


def test_weights_are_reached(spark):
    df = spark.range(60000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' when id % 30 = 1 then null else 's' || id % 4 end as source", "1 as replica", "'t' as text")
    got = mix_sources(df)
    n = Counter(r.source for r in df.collect())
    w = {k: math.sqrt(v) for k, v in n.items()}
    out = Counter(r.source for r in got.collect())
    for k in n:
        want = 60000 * w[k] / sum(w.values())
        assert abs(out[k] - want) < 6 * math.sqrt(want)
    rows = got.collect()
    assert [r.mix_order for r in rows] == sorted(r.mix_order for r in rows) and got.columns == ["doc_id", "source", "text", "replica", "mix_order"]
    assert len({(r.doc_id, r.replica) for r in rows}) == len(rows)
    given = spark.createDataFrame([("hot", 3.0), ("s1", 1.0), (None, 1.0)], "source string, weight double")
    c = Counter(r.source for r in mix_sources(df, given, size=0.5).collect())
    assert set(c) == {"hot", "s1", None} and abs(c["hot"] - 18000) < 800


def test_edges(docs, spark):
    odd = spark.createDataFrame([(None, None, None, 5, 6.0), (1, "x", "a", 7, 8.0), (1, "x", "a", 7, 8.0)], "doc_id long, text string, source string, k int, mean double")
    assert {(r.k, r.mean) for r in mix_sources(odd, size=4.0).collect()} <= {(5, 6.0), (7, 8.0)}
    lost = spark.createDataFrame([(None, f"text {i}", "a") for i in range(2000)], "doc_id long, text string, source string")
    assert 1700 < mix_sources(lost).count() < 2300 and len({r.text for r in mix_sources(lost).collect()}) > 1000
    assert mix_sources(odd, size=4.0).count() == mix_sources(odd.repartition(3), size=4.0).count() > 0
    assert mix_sources(odd.where("false")).collect() == []
