import pytest
from pyspark.sql import functions as F

from cytolake.config import merge_type, report_type
from cytolake.functions import gff
from cytolake.operators import annotation, intervals, ordering, pvalues
from cytolake.plans import validate
from cytolake.sources.native import find

REGION = "chr string, start long, end long, k int"


def test_index_find(spark):
    index = spark.createDataFrame([("x", 10, 19, 1), ("x", 15, 40, 2), ("x", 41, 77, 3), ("y", 10, 19, 4)], REGION)
    for query, expected in ((("x", 19, 41), [1, 2]), (("x", 40, 42), [2, 3]), (("x", 78, 900), []), (("y", 0, 10), []), (("y", 0, 11), [4])):
        assert sorted(r["k"] for r in find(index, *query).collect()) == expected


@pytest.mark.parametrize("width", [1, 10, 64, 10_000])
def test_overlaps_against_all_pairs(spark, width):
    a = [("x", s, s + n, k) for k, (s, n) in enumerate([(0, 5), (3, 40), (60, 1), (100, 100), (120, 3)])]
    b = [("x", s, s + n, k) for k, (s, n) in enumerate([(4, 1), (5, 20), (43, 17), (61, 60), (150, 500)])] + [("y", 0, 900, 9)]
    got = intervals.overlapping(spark.createDataFrame(a, REGION), spark.createDataFrame(b, REGION), width)
    assert sorted((r["k_a"], r["k_b"]) for r in got.collect()) == sorted((p[3], q[3]) for p in a for q in b if p[0] == q[0] and p[1] < q[2] and p[2] > q[1])
    points = spark.createDataFrame([("x", p) for p in range(0, 210, 3)], "chr string, position long")
    got = intervals.in_regions(points, spark.createDataFrame(a, REGION), width)
    assert sorted((r["position"], r["k"]) for r in got.collect()) == sorted((p, q[3]) for p in range(0, 210, 3) for q in a if q[1] <= p < q[2])


def test_joins_keep_an_equality_and_filters_reach_the_scan(spark):
    s = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(F.lit("chr1").alias("chr"), F.col("l_orderkey").alias("position"))
    text = intervals.in_regions(s, spark.createDataFrame([("chr1", 1, 5, 1)], REGION))._jdf.queryExecution().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert "GreaterThanOrEqual(l_orderkey" in intervals.query(s, "chr1", 5, 9)._jdf.queryExecution().toString()


def test_strict_query(spark):
    s = spark.createDataFrame([("a", 1)], "chr string, position long")
    assert intervals.query(s, "b", 0, 9).count() == 0
    with pytest.raises(ValueError):
        intervals.query(s, "b", 0, 9, strict=True)


def test_from_breakpoints(spark):
    points = spark.createDataFrame([("c", 100), ("c", 200)], "chr string, position long")
    take = lambda df: sorted((r["start"], r["end"]) for r in df.collect())
    assert take(intervals.from_breakpoints(points)) == [(0, 100), (100, 200)]
    assert take(intervals.from_breakpoints(points, reference=True)) == [(0, 100), (0, 200)]


def test_resampled(spark):
    values = spark.createDataFrame([("c", 0, 10, 1.0), ("c", 10, 20, 3.0)], "chr string, start long, end long, value double")
    bins = spark.createDataFrame([("c", 0, 5), ("c", 5, 15), ("c", 30, 40)], "chr string, start long, end long")
    got = [r["value"] for r in intervals.resampled(values, bins).orderBy("start").collect()]
    assert got[:2] == [1.0, 2.0] and got[2] != got[2]


def test_order(spark):
    regions = spark.createDataFrame([(c, s, s + 3, s) for s in (8, 2, 5) for c in ("m", "n", "o")], REGION)
    got = ordering.regions_sorted(regions, ordering.chr_order(spark, ["o", "m", "n"])).collect()
    assert [(r["chr"], r["start"]) for r in got] == [(c, s) for c in ("o", "m", "n") for s in (2, 5, 8)]


def test_attributes(spark):
    text = "Name=left arm;ID=q7;depth=low;Alias=one,two,three;Target=z;pair=u=v;"
    r = spark.createDataFrame([(text,), (None,)], "t string").select(gff.attributes(F.col("t")).alias("a")).select("a", gff.attributes_text(F.col("a")).alias("s")).collect()
    a = r[0]["a"]
    assert (a["id"], a["name"], a["alias"], a["other"]) == ("q7", ["left arm"], ["one", "two", "three"], {"depth": "low", "pair": "u=v"})
    assert r[0]["s"] == "ID=q7;Name=left arm;Alias=one,two,three;depth=low;pair=u=v" and r[1]["s"] == ""


def test_tree(spark):
    edges = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("e", "zz"), ("b", "d")], "id string, parent string")
    assert [r["id"] for r in annotation.orphans(edges).collect()] == ["e"]
    assert [r["id"] for r in annotation.twice_parented(edges).collect()] == ["b"]
    assert sorted(r["id"] for r in annotation.without_subtree(edges.filter("not (id = 'b' and parent = 'd')"), "b").collect()) == ["a", "d", "e"]


def test_mann_whitney_is_symmetric(spark):
    rows = [(v, True) for v in (1.5, 2.3, 3.1, 4.8, 5.7, 5.6)] + [(v, False) for v in (2.0, 3.5, 3.8, 4.0, 6.2, 3.5)]
    df = spark.createDataFrame([("k", v, f) for v, f in rows], "k string, v double, f boolean")
    one, two = (pvalues.mann_whitney_p(df, "v", c, "k").first() for c in (F.col("f"), ~F.col("f")))
    assert one["p"] == pytest.approx(two["p"]) and 0 < one["p"] <= 1
    none = pvalues.mann_whitney_p(df.filter("f"), "v", F.col("f"), "k").first()
    assert (none["u"], none["p"]) == (0, 1)


def test_adjusted(spark):
    df = spark.createDataFrame([(k, p) for k, p in enumerate((0.01, 0.04, 0.03, 0.5))], "k int, p_value double")
    take = lambda m: [round(r["padj"], 6) for r in pvalues.adjusted(df, method=m).orderBy("k").collect()]
    assert take("bh") == [0.04, round(0.16 / 3, 6), round(0.16 / 3, 6), 0.5]
    assert take("bonferroni") == [0.04, 0.16, 0.12, 1.0] and take("none") == [0.01, 0.04, 0.03, 0.5]
    assert take("by")[0] == round(0.04 * (1 + 1 / 2 + 1 / 3 + 1 / 4), 6)


def test_pearson(spark):
    df = spark.createDataFrame([("a", float(i), float(i + 5)) for i in range(1, 7)] + [("b", 1.0, 2.0)], "k string, x double, y double")
    assert {r["k"]: round(r["r"], 9) for r in pvalues.pearson(df, "x", "y", "k").collect()} == {"a": 1.0, "b": 0.0}


def test_validate(spark):
    rows = [(s, "c", b, p) for s in ("x", "y", "z") for b, p in ((0, 1), (0, 5), (1, 9))]
    good = spark.createDataFrame(rows, "sample string, chr string, batch long, position long")
    assert validate.validate(good, deep=True) == []
    moved = good.withColumn("position", F.when((F.col("sample") == "z") & (F.col("position") == 5), 4).otherwise(F.col("position")))
    assert len(validate.validate(moved)) == 1
    assert validate.validate(good.filter("not (sample = 'z' and batch = 1)"))[0].startswith("z: 1 batches")


def test_options():
    assert merge_type("Full").kind == "full" and merge_type("dbscan:5:3:100:median").eps == 5.0
    assert report_type("CgMap").strand == "nuc" and report_type("bedgraph").aligned
    for bad in ("dbscan", "full:1", "other"):
        with pytest.raises(ValueError):
            merge_type(bad)
