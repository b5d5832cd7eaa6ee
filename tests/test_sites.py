"""Golden cases of the site operators."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cytolake.functions import scalar
from cytolake.functions.aggregates import over_array, over_rows
from cytolake.operators import bins, context, ranges, replicates, sites, stats


@pytest.fixture(scope="module")
def five(spark):
    return sites.from_columns(spark, "chr1", [3, 5, 9, 12, 15], [True, False, True, True, False], [True, False, True, None, None], [5, 10, 15, 10, 5], [10, 30, 20, 10, 10]).cache()


def positions(df):
    return sorted(r["position"] for r in df.select("position").collect())


@pytest.mark.parametrize(
    ("test", "expected"),
    [
        (lambda: sites.pos_lt(10), [3, 5, 9]),
        (lambda: sites.pos_gt(10), [12, 15]),
        (lambda: sites.coverage_gt(10), [5, 9]),
        (lambda: sites.strand_is(True), [3, 9, 12]),
        (lambda: sites.strand_is(False), [5, 15]),
        (lambda: sites.strand_is(None), []),
        (lambda: sites.context_is("CG"), [3, 9]),
        (lambda: sites.context_is("chg"), [5]),
        (lambda: sites.context_is("CHH"), [12, 15]),
    ],
)
def test_filters(five, test, expected):
    assert positions(five.filter(test())) == expected


def test_slice_and_split(five):
    assert positions(sites.sliced(five, 1, 3, width=4)) == [5, 9, 12]
    left, right = sites.split_at(five, 2, width=4)
    assert positions(left) == [3, 5] and positions(right) == [9, 12, 15]


def test_binarized(five):
    rows = sites.binarized(five, 0.5, 0.05).orderBy("position").collect()
    assert [r["count_m"] for r in rows] == [0, 0, 1, 1, 0]
    assert [r["count_total"] for r in rows] == [1] * 5
    assert [r["density"] for r in rows] == [0, 0, 1, 1, 0]


def test_binomial_tail_against_sum(spark):
    rows = spark.createDataFrame([(m, n) for n in (0, 1, 7, 40, 3000) for m in sorted({0, min(1, n), n // 3, n})], "m long, n long")
    for r in rows.withColumn("p", scalar.binomial_tail(F.col("m"), F.col("n"), 0.4)).collect():
        if r["n"] == 0:
            assert math.isnan(r["p"])
        elif r["m"] in (0, r["n"]):
            assert r["p"] == (1.0 if r["m"] == 0 else 0.0)
        else:
            terms = (math.lgamma(r["n"] + 1) - math.lgamma(k + 1) - math.lgamma(r["n"] - k + 1) + k * math.log(0.4) + (r["n"] - k) * math.log(0.6) for k in range(r["m"] + 1))
            assert r["p"] == pytest.approx(1 - math.fsum(map(math.exp, terms)), abs=1e-9)


def test_discretised(five):
    rows = bins.discretised(five, 2).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [3, 2]
    assert [r["rel_end"] for r in rows] == [pytest.approx(9 / 13), 1.0]
    wide = bins.discretised(five, 30).orderBy("bin").collect()
    assert len(wide) == 30 and sum(r["n"] for r in wide) == 5 and math.isnan(wide[0]["value"])
    for n in (1, 2, 7, 13, 30, 90):
        targets = [math.floor(3 + i * 13 / n + 0.5) for i in range(1, n)]
        expected = sorted(sum(t <= p for t in targets) for p in (3, 5, 9, 12, 15))
        assert sorted(r["bin"] for r in bins.discretised(five, n).collect() for _ in range(r["n"])) == expected


def test_partition(five):
    rows = bins.partition(five, [3], width=4).orderBy("part").collect()
    assert [(r["part"], r["n"], r["rel_end"]) for r in rows] == [(0, 3, pytest.approx(9 / 13)), (1, 2, 1.0)]
    assert bins.partition(five, []).count() == 0
    with pytest.raises(ValueError):
        bins.partition(five, [0, 2])


def test_reports_out_and_in(five):
    cov = sites.to_coverage(five).orderBy("start").collect()
    assert [r["count_um"] for r in cov] == [5, 20, 5, 0, 5] and all(r["end"] == r["start"] + 1 for r in cov)
    cg = sites.to_cgmap(five).orderBy("position").collect()
    assert [r["nuc"] for r in cg] == list("CGCCG") and [r["dinuc"] for r in cg] == ["CG", "CH", "CG", "CH", "CH"]
    back = sites.from_bismark(sites.to_bismark(five))
    assert sorted(map(tuple, back.collect()), key=lambda r: r[1]) == sorted(map(tuple, five.collect()), key=lambda r: r[1])


def test_bedgraph_drops_nan_and_keeps_null(spark):
    rows = sites.from_columns(spark, "c", [1, 2], [None, None], [None, None], [0, None], [0, None])
    assert [r["start"] for r in sites.to_bedgraph(rows).collect()] == [2]


def test_checks(spark):
    make = lambda *p: spark.createDataFrame(list(p), "chr string, position long")
    assert sites.require(make(("a", 1), ("a", 2))).count() == 2
    for bad in (make(("a", 1), ("a", 1)), make((None, 1)), make(("a", None))):
        with pytest.raises(ValueError, match="not valid"):
            sites.require(bad)
    with pytest.raises(ValueError, match="extra_chromosomes"):
        sites.require(make(("a", 1), ("b", 1)), single_chr=True)
    v = sites.order_violations(spark.createDataFrame([("a", 5, 0), ("a", 3, 1), ("a", 3, 2)], "chr string, position long, o int"), "o").first()
    assert (v["unsorted"], v["repeated"]) == (1, 1)


@pytest.mark.parametrize("width", [1, 2, 1 << 20])
def test_order_violations_of_ties(spark, width):
    """Rows of one order stand by position, whatever their order in the input and the ranges."""
    rows = [("a", 9, 0), ("a", 3, 0), ("a", 3, 0), ("a", 5, 1), ("a", 7, 2), ("a", 6, 2), ("a", 8, 3), ("b", 4, 0), ("b", 2, 0), ("b", 4, 1)]
    for given in (rows, rows[::-1], sorted(rows)):
        found = sites.order_violations(spark.createDataFrame(given, "chr string, position long, o int").coalesce(1), "o", width=width)
        assert sorted(map(tuple, found.collect())) == [("a", 1, 1), ("b", 0, 1)]


def test_concatenated(spark, five):
    shifted = five.withColumn("position", F.col("position") + 100)
    assert sites.concatenated([five, shifted]).count() == 10
    for bad in ([shifted, five], [five, five.withColumn("position", F.col("position") + 12)]):
        with pytest.raises(ValueError):
            sites.concatenated(bad)
    with pytest.raises(ValueError):
        sites.concatenated([])


def test_strict_cast(spark):
    with pytest.raises(PySparkException):
        sites.cast(spark.createDataFrame([("a", "x", True, True, 1, 1, 0.5)], "chr string, position string, strand boolean, context boolean, count_m int, count_total int, density double")).collect()


def test_replicates(spark):
    a = sites.from_columns(spark, "c", [10, 20], [True] * 2, [True] * 2, [2, 4], [10, 8])
    b = sites.from_columns(spark, "c", [10, 20], [True] * 2, [True] * 2, [3, 6], [10, 12]).withColumn("density", F.when(F.col("position") == 10, 0.3).otherwise(0.5))
    m = replicates.merged(replicates.sampled({"a": a, "b": b})).orderBy("position").collect()
    assert [(r["count_m"], r["count_total"], round(r["density"], 6)) for r in m] == [(5, 20, 0.25), (10, 20, 0.5)]
    assert replicates.merged(a.withColumn("sample", F.lit("a"))).count() == 2
    with pytest.raises(ValueError):
        replicates.sampled({})


def test_alignment(spark):
    s = sites.from_columns(spark, "c", [10, 20, 30], [None] * 3, [None] * 3, [5, 10, 15], [10, 20, 30])
    c = spark.createDataFrame([("c", 10, False, True), ("c", 20, False, False), ("c", 25, True, None), ("c", 30, True, True)], "chr string, position long, strand boolean, context boolean")
    rows = context.aligned(s, c).orderBy("position").collect()
    assert [r["position"] for r in rows] == [10, 20, 25, 30] and [r["count_m"] for r in rows] == [5, 10, 0, 15] and [r["count_total"] for r in rows] == [10, 20, 0, 30]
    assert math.isnan(rows[2]["density"]) and rows[0]["density"] == 0.5 and [r["strand"] for r in rows] == [False, False, True, True]


@pytest.mark.parametrize(
    ("sequence", "start", "expected"),
    [
        # (fixed values) a sequence whose context rows are known
        ("CCGTAG", 1, [(1, True, False), (2, True, True), (3, False, True), (6, False, None)]),
        ("ccgtag", 10, [(10, True, False), (11, True, True), (12, False, True), (15, False, None)]),
        ("ATCG", 1, [(3, True, True), (4, False, True)]),
        ("", 1, []),
        ("A", 1, []),
        ("AT", 1, []),
        ("ATC", 1, []),
    ],
)
def test_context_scan(spark, sequence, start, expected):
    g = spark.createDataFrame([("c", sequence)], "chr string, sequence string")
    found = sorted(((r["position"], r["strand"], r["context"]) for r in context.scanned(g, start=start).collect()), key=lambda x: (x[0], x[1]))
    assert found == expected


def test_region_stats(spark):
    s = sites.from_columns(spark, "c", [1, 2, 3], [True, True, False], [True, True, False], [8, 6, 4], [10, 10, 5])
    rows = {(r["kind"], r["label"]): r for r in stats.region_stats(s).collect()}
    assert rows["context", "CG"]["sum_density"] == pytest.approx(1.4) and rows["context", "CG"]["mean"] == pytest.approx(0.7)
    assert rows["context", "CHG"]["n"] == 1 and rows["strand", "-"]["sum_density"] == pytest.approx(0.8)
    assert {(r["count_total"], r["n"]) for r in stats.coverage_histogram(s).collect()} == {(10, 2), (5, 1)}


def test_aggregates(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 4.0)], "v double")
    for name, expected in (("mean", 7 / 3), ("sum", 7), ("gmean", 2), ("median", 2), ("max", 4), ("min", 1)):
        assert df.agg(over_rows(name, F.col("v"))).first()[0] == pytest.approx(expected)
        assert df.limit(1).select(over_array(name, F.array(*map(F.lit, (4.0, 1.0, 2.0))))).first()[0] == pytest.approx(expected)
    assert df.filter("v > 9").agg(over_rows("sum", F.col("v"))).first()[0] == 0
    assert math.isnan(df.filter("v > 9").agg(over_rows("mean", F.col("v"))).first()[0])


@pytest.mark.parametrize("width", [1, 3, 7, 1000])
def test_ranges_do_not_depend_on_width(spark, width):
    at = [1, 2, 4, 9, 10, 30, 31, 62, 200]
    df = spark.createDataFrame([(c, p, 1) for c in "ab" for p in at], "chr string, position long, count_m long").withColumn("count_total", F.lit(2))
    rows = ranges.gap_segments(ranges.cumulative_counts(df, width), 20, width=width).filter("chr = 'a'").orderBy("position").collect()
    assert [r["segment"] for r in rows] == [0, 0, 0, 0, 0, 1, 1, 2, 3]
    assert [r["cum_m"] for r in rows] == list(range(1, 10)) and rows[-1]["cum_total"] == 18
    chunks = ranges.overlapping_chunks(df, 4, 1, width).filter("chr = 'a'").groupBy("chunk").agg(F.sort_array(F.collect_list("position")).alias("p")).orderBy("chunk").collect()
    assert [c["p"] for c in chunks] == [[1, 2, 4, 9, 10], [10, 30, 31, 62, 200], [200]]


def test_contigs_and_positions(spark):
    one = spark.range(1)
    c = scalar.contig(F.lit("chrX"), F.lit(1000), F.lit(2000), F.lit(True))
    assert one.select(scalar.contig_text(c)).first()[0] == "chrX:1000-2000 (+)"
    box = lambda s, e, q="c": scalar.contig(F.lit(q), F.lit(s), F.lit(e))
    for other, order in ((box(250, 300), -1), (box(50, 90), 1), (box(150, 250), None), (box(100, 200, "d"), None)):
        assert one.select(scalar.contig_order(box(100, 200), other)).first()[0] == order
    p = F.struct(F.lit("c").alias("seqname"), F.lit(5).alias("position"))
    q = F.struct(F.lit("c").alias("seqname"), F.lit(7).alias("position"))
    assert one.select(scalar.subtract_positions(q, p)["position"]).first()[0] == 2
    assert one.select(scalar.subtract_positions(p, q)).first()[0] is None
    assert one.select(scalar.extend_upstream(box(3, 9), 5)["start"]).first()[0] == 0
