"""Round trips through files."""

import bz2
import gzip
import lzma
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cytolake.operators import sites
from cytolake.operators.ordering import chr_order
from cytolake.plans import cli, convert
from cytolake.sources import annot, arrow_ipc, genome, native, reports
from cytolake.streaming import ingest

BISMARK = "chr1\t100\t+\t5\t5\tCG\tCGA\nchr1\t150\t-\t10\t10\tCHG\tCAG\n"


@pytest.fixture(scope="module")
def some(spark):
    rows = [("chr1", p, p % 2 == 0, [True, False, None][p % 3], p % 7, 7 + p % 5, (p % 7) / (7 + p % 5)) for p in range(1, 300)] + [("chr2", p, None, None, 1, 2, 0.5) for p in range(5, 50)]
    return spark.createDataFrame(rows, "chr string, position long, strand boolean, context boolean, count_m long, count_total long, density double").cache()


def same(a, b):
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, a.select(b.columns).collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


@pytest.mark.parametrize("ending", ["", ".gz", ".bz2", ".xz", ".zip", ".lz4"])
def test_compressed_reports(spark, tmp_path, ending):
    path = tmp_path / f"r.tsv{ending}"
    if ending == ".zip":
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("r.tsv", BISMARK)
    elif ending == ".lz4":
        with pa.CompressedOutputStream(str(path), "lz4") as f:
            f.write(BISMARK.encode())
    else:
        open_ = {"": open, ".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open}[ending]
        with open_(path, "wb") as f:
            f.write(BISMARK.encode())
    rows = reports.read_sites(spark, str(path), "bismark").orderBy("position").collect()
    assert [(r["position"], r["strand"], r["context"], r["count_m"], r["count_total"], r["density"]) for r in rows] == [(100, True, True, 5, 10, 0.5), (150, False, False, 10, 20, 0.5)]


@pytest.mark.parametrize(("kind", "codec"), [("bismark", None), ("bismark", "gzip"), ("cgmap", "bzip2"), ("coverage", "xz"), ("bedgraph", None), ("bedgraph", "zst"), ("cgmap", "zip")])
def test_report_round_trip(spark, tmp_path, some, kind, codec):
    out = str(tmp_path / "out")
    reports.write_report(some, out, kind, codec)
    if codec in ("xz", "zst", "zip"):
        reports.unpack(spark, out, str(tmp_path / "files"))
        out = str(tmp_path / "files" / f"*.{codec}")
    if codec == "zst":  # Spark reads it where Hadoop has the codec
        import zstandard

        raw = b"".join(zstandard.ZstdDecompressor().decompressobj().decompress(p.read_bytes()) for p in sorted((tmp_path / "files").iterdir()))
        assert raw.startswith(b"track") and raw.count(b"\nchr") == some.count()
        return
    back = sites.FROM_REPORT[kind](reports.read_rows(spark, out, kind))
    expected = sites.FROM_REPORT[kind](sites.TO_REPORT[kind](some))
    rounded = lambda d: d.withColumn("density", F.round("density", 9))
    same(rounded(back), rounded(expected))


def test_genome_and_alignment(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">c1 first\nCCG\nTAG\n>c2\nATCG\n")
    g = genome.read_fasta(spark, str(tmp_path / "g.fa"))
    assert sorted(map(tuple, g.collect())) == [("c1", "CCGTAG"), ("c2", "ATCG")]
    (tmp_path / "g.fai").write_text("c2\t4\t20\t4\t5\nc1\t6\t3\t3\t4\n")
    assert [r["chr"] for r in genome.read_fai(spark, str(tmp_path / "g.fai")).orderBy("ord").collect()] == ["c1", "c2"]
    (tmp_path / "b.bedgraph").write_text("track x\nc1\t2\t3\t0.5\n")
    with pytest.raises(ValueError, match="genome"):
        reports.read_sites(spark, str(tmp_path / "b.bedgraph"), "bedgraph")
    assert cli.main(["to-native", str(tmp_path / "b.bedgraph"), str(tmp_path / "store"), "--kind", "bedgraph", "--fasta", str(tmp_path / "g.fa")], spark) == 0
    rows = {(r["chr"], r["position"]): r["density"] for r in native.read(spark, str(tmp_path / "store")).collect()}
    assert rows["c1", 2] == 0.5 and len(rows) == 6
    with pytest.raises(ValueError):
        convert.to_native(spark, "x", "bismark", "y")


def test_native_store(spark, tmp_path, some):
    path = str(tmp_path / "s")
    native.write(some, path, 100, range_width=64)
    store = native.read(spark, path)
    same(store.drop("batch"), some)
    assert native.blocks_total(store) == 4 and native.batches(store, 0).count() == 145 and native.last_batches(store).count() == 99 + 45
    text = store.filter("chr = 'chr1' and position > 50")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(chr" in text and "GreaterThan(position,50)" in text
    native.write_index(store, str(tmp_path / "i"))
    assert native.find(native.read_index(spark, str(tmp_path / "i")), "chr1", 100, 101).count() == 1
    assert [r["chr"] for r in convert.sort(spark, path, str(tmp_path / "t"), ["chr2"]).select("chr").distinct().collect()] == ["chr2"]
    native.write(some, str(tmp_path / "u"), order=chr_order(spark, ["chr2"]))
    assert native.read(spark, str(tmp_path / "u")).count() == 45
    assert cli.main(["validate", path, path], spark) == 0


@pytest.mark.parametrize("codec", ["none", "lz4", "zstd"])
def test_arrow_ipc(spark, tmp_path, some, codec):
    spark.dataSource.register(arrow_ipc.ArrowIPC)
    folder = str(tmp_path / "ipc")
    some.coalesce(2).write.format("arrow_ipc").option("compression", codec).mode("append").save(folder)
    back = spark.read.format("arrow_ipc").load(folder)
    same(back, some)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    pushed = spark.read.format("arrow_ipc").option("pushdown", "true").load(folder)
    assert pushed.filter("chr = 'chr1' and position < 10").count() == 9
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_arrow_files_of_other_writers(spark, tmp_path):
    """Dictionaries and narrow types are widened, stripes share a file's batches, a URI is as good as a path."""
    spark.dataSource.register(arrow_ipc.ArrowIPC)
    kinds = pa.schema([("chr", pa.dictionary(pa.int32(), pa.string())), ("position", pa.uint32()), ("strand", pa.bool_()), ("context", pa.bool_()), ("count_m", pa.uint16()), ("count_total", pa.uint16()), ("density", pa.float32())])
    with pa.OSFile(str(tmp_path / "a.arrow"), "wb") as f, pa.ipc.new_file(f, kinds) as w:
        for k in range(5):
            values = [["c1"] * 3, [3 * k, 3 * k + 1, 3 * k + 2], [True, None, False], [None, True, False], [1, 2, 3], [2, 4, 6], [0.5, 0.5, 0.5]]
            w.write_batch(pa.RecordBatch.from_arrays([pa.array(v, t.type) if not pa.types.is_dictionary(t.type) else pa.array(v).dictionary_encode() for v, t in zip(values, kinds)], schema=kinds))
    rows = spark.read.format("arrow_ipc").load(f"file://{tmp_path}").orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(15)) and {r["chr"] for r in rows} == {"c1"} and rows[0]["density"] == 0.5
    reader = arrow_ipc.Reader(str(tmp_path))
    parts = [arrow_ipc.Stripe(str(tmp_path / "a.arrow"), k, 2) for k in range(2)]
    assert sorted(p for part in parts for b in reader.read(part) for p in b.column("position").to_pylist()) == list(range(15))
    assert len(reader.partitions()) == 1 and len(arrow_ipc.files(str(tmp_path / "*.arrow"))) == 1
    with pytest.raises(FileNotFoundError):
        arrow_ipc.files(str(tmp_path / "none"))


def test_overwrite_that_fails_leaves_the_files(spark, tmp_path, some):
    spark.dataSource.register(arrow_ipc.ArrowIPC)
    folder = str(tmp_path / "ipc")
    some.write.format("arrow_ipc").mode("append").save(folder)
    broken = some.withColumn("density", F.when(F.col("position") > 290, F.raise_error(F.lit("no"))).otherwise(F.col("density")).cast("double"))
    with pytest.raises(Exception, match="no"):
        broken.write.format("arrow_ipc").mode("overwrite").save(folder)
    same(spark.read.format("arrow_ipc").load(folder), some)
    some.limit(3).write.format("arrow_ipc").mode("overwrite").save(folder)
    assert spark.read.format("arrow_ipc").load(folder).count() == 3


def test_folder_with_several_codecs(spark, tmp_path):
    (tmp_path / "a.tsv").write_text(BISMARK)
    with lzma.open(tmp_path / "b.tsv.xz", "wt") as f:
        f.write(BISMARK.replace("chr1", "chr2"))
    with gzip.open(tmp_path / "c.tsv.gz", "wt") as f:
        f.write(BISMARK.replace("chr1", "chr3"))
    assert {r["chr"] for r in reports.read_sites(spark, str(tmp_path), "bismark").collect()} == {"chr1", "chr2", "chr3"}


def test_levels(spark, tmp_path, some):
    for codec in ("gzip", "xz", "zst", "zip"):
        for level in (1, 9):
            reports.write_report(some, str(tmp_path / f"{codec}{level}"), "bismark", codec, level)
    with pytest.raises(ValueError, match="levels"):
        reports.write_report(some, str(tmp_path / "x"), "bismark", "gzip", 11)
    assert reports.read_rows(spark, str(tmp_path / "gzip9"), "bismark").count() == some.count()


def test_a_store_keeps_its_order(spark, tmp_path, some):
    path = str(tmp_path / "s")
    native.write(some, path, 100, chr_order(spark, ["chr2", "chr1"]), range_width=64)
    assert [(r["chr"], r["ord"]) for r in native.read_order(spark, path).orderBy("ord").collect()] == [("chr2", 0), ("chr1", 1)]
    rows = [(r["chr"], r["position"]) for r in native.read_sorted(spark, path).collect()]
    assert rows == [("chr2", p) for p in range(5, 50)] + [("chr1", p) for p in range(1, 300)]
    native.write(some, str(tmp_path / "t"), 100)
    assert native.read_order(spark, str(tmp_path / "t")) is None and native.nth(native.read(spark, path), 3).count() == 45


def test_all_disagreements_are_named(spark):
    from cytolake.plans import validate

    rows = [(s, "c", 100 * b + k + (s == "b"), b) for s in "ab" for b in range(25) for k in range(3)]
    df = spark.createDataFrame(rows, "sample string, chr string, position long, batch long")
    assert len(validate.validate(df)) == 25 and validate.validate(df.filter("sample = 'a'").unionByName(df.filter("sample = 'a'").withColumn("sample", F.lit("c"))), True) == []
    swapped = [("a", "c", p, 0) for p in (1, 4, 6, 9)] + [("b", "c", p, 0) for p in (1, 5, 5, 9)]
    assert len(validate.validate(spark.createDataFrame(swapped, df.schema), True)) == 1


def test_annotation_files(spark, tmp_path):
    (tmp_path / "a.gff").write_text("##gff-version 3\nc\ts\tgene\t1\t90\t.\t+\t.\tID=g1;Name=n\nc\ts\texon\t5\t20\t0.5\t-\t1\tParent=g1\n")
    from cytolake.operators.annotation import entries, with_parents

    e = entries(annot.read_gff(spark, str(tmp_path / "a.gff")))
    rows = {r["feature_type"]: r for r in with_parents(e).collect()}
    assert rows["exon"]["parent_id"] == "g1" and rows["gene"]["score"] is None and rows["exon"]["phase"] == 1 and len(rows["exon"]["id"]) == 16
    annot.write_gff(e, str(tmp_path / "b"))
    assert annot.read_gff(spark, str(tmp_path / "b")).count() == 2
    (tmp_path / "s.bed").write_text("c\t0\t5\tx\t0.5\n")
    assert annot.read_segments(spark, str(tmp_path / "s.bed")).first()["value"] == 0.5
    (tmp_path / "t.bed").write_text("c\t0\t5\tx\tno\n")
    assert annot.read_bed(spark, str(tmp_path / "t.bed")).first()["score"] != 0
    with pytest.raises(Exception, match="positive score"):
        annot.read_segments(spark, str(tmp_path / "t.bed")).collect()


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.tsv").write_text(BISMARK)
    run = lambda: ingest.append(spark, str(folder), "bismark", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    run()
    (folder / "2.tsv").write_text(BISMARK.replace("chr1", "chr9"))
    run()
    run()
    assert sorted(r["chr"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["chr1", "chr1", "chr9", "chr9"]
    assert {r["batch"] for r in native.read(spark, str(tmp_path / "out")).collect()} == {0}


@pytest.mark.parametrize("args", [["sort", "/none/x", "/none/y"], ["merge", "/none/*.bed", "--output", "o"], ["validate", "/none/s"], ["to-native", "/none/r", "/none/s", "--fai", "/none/f"]])
def test_commands_ask_for_their_inputs(spark, args):
    with pytest.raises(FileNotFoundError, match="/none"):
        cli.main(args, spark)
