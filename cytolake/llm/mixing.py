"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only.

Each source is a queue of its documents in a shuffled, repeatable order. A document's virtual finish time is the
source's words up to its end, divided by the source's target. All packets of all queues are sorted by finish time
over ranges of virtual time, and the mix is what comes before the total budget runs out. A document that straddles
its source's target is served as two packets, so that the mix meets the targets to the word.

Running totals within a source have three levels: totals of blocks of hash ranges, of ranges, and rows within one
range; of all packets, the budget's place is found in a range of virtual time, then in a part of that range, and only
the packets of that part are sorted. No task sees a whole source, however hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytolake.llm._common import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of virtual time, and parts of one range; the sort inside one part is all that a single task does.
TIME_RANGES = 8192
#: Documents in one hash range of a source, about, and ranges of a block.
RANGE_ROWS, BLOCK_RANGES = 500, 4096


def shuffled(key: Column, text: Column, seed: int) -> Column:
    """A document's place in the shuffled order: the first 60 bits of a digest of seed, key and text."""
    whole = F.concat_ws("|", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, source: str, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Rows of sizes (source, source_size) with weight and target: share of all words by weight, at most ``most``
    times a source's words; the excess goes to the others by weight (water filling).

    With sources by rising cap/weight, the level is the largest of (budget - caps before) / (weights from here)."""
    by_name, by_ratio = Window.orderBy(F.col(source).asc_nulls_last()), Window.orderBy("ratio", "place")
    every = Window.partitionBy()
    place = F.row_number().over(by_name) - 1
    cap = F.col("source_size") * F.lit(float(most))
    return (
        sizes.withColumn("place", place)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") % len(weights) + 1))
        .withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.max((F.col("budget") - F.col("before")) / F.col("left")).over(every))
        .withColumn("target", F.greatest(F.lit(0.0), F.least("cap", F.col("weight") * F.col("level"))))
        .select(source, "source_size", "weight", "target")
    )


def _packets() -> list[tuple[Column, Column, Column]]:
    """(first word, words, finish) of a row's packets: two passes, each cut where the source meets its target."""
    out = []
    quota = F.floor("target")
    for turn in (0, 1):
        start = F.col("ahead") + turn * F.col("source_size")
        early = F.greatest(F.lit(0), F.least("size", quota - start))
        per = F.when(F.col("target") > 0, F.col("target"))
        out += [(start, early, (start + early) / per), (start + early, F.col("size") - early, (start + F.col("size")) / per)]
    return out


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """One row per input row: key, source, shuffle (the row's place in the shuffled order), size, source_size, target, taken.

    size counts words (null text: 0). taken is at most twice the size; the words taken of a source come to its target.
    Null sources form one source, the last. Rows without words take no part and have taken 0; repeated rows count
    each; an empty table gives an empty result. Other columns are ignored, so their names cannot clash.
    Runs agree: the order comes from a hash of key and text."""
    if most != 2.0:
        raise ValueError("documents are served in two passes: most is 2")
    rows = docs.select(
        F.col(key).alias("key"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        shuffled(F.col(key), F.col(text), seed).alias("shuffle"),
    )
    rows = stored(rows, "mix-sizes")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    ranges = max(64, total["n"] // RANGE_ROWS)
    rows = rows.withColumn("range", F.floor(F.col("shuffle") / 2.0**60 * ranges).cast("long"))

    by_range = rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
    per_source = targets(by_range.groupBy("source").agg(F.sum("words").alias("source_size")), "source", weights, share, most)
    by_range = by_range.withColumn("block", F.floor(F.col("range") / BLOCK_RANGES).cast("long"))
    ahead = lambda keys, order: F.coalesce(F.sum("words").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_block = by_range.groupBy("source", "block").agg(F.sum("words").alias("words")).withColumn("before", ahead(["source"], "block"))
    r, b = by_range.withColumn("inside", ahead(["source", "block"], "range")).alias("r"), by_block.alias("b")
    offsets = r.join(b, F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.block") == F.col("b.block"))).select("r.source", "range", (F.col("before") + F.col("inside")).alias("offset"))
    s, o = per_source.alias("s"), offsets.alias("o")
    offsets = o.join(s, F.col("o.source").eqNullSafe(F.col("s.source"))).select("o.source", "o.range", "offset", "source_size", "target")

    inside = Window.partitionBy("source", "range").orderBy("shuffle", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    r, o = rows.withColumn("upto", F.sum("size").over(inside)).alias("r"), offsets.alias("o")
    queued = r.join(o, F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.range") == F.col("o.range"))).select(
        "key", F.col("r.source").alias("source"), "shuffle", "size", "source_size", "target", (F.col("offset") + F.col("upto") - F.col("size")).alias("ahead")
    )
    queued = stored(queued, "mix-queues")

    budget = int(total["words"] * share)
    packets = queued.select("shuffle", F.explode(F.array(*[F.struct(a.alias("first"), w.alias("words"), v.alias("finish")) for a, w, v in _packets()])).alias("p")).select("shuffle", "p.*").filter("words > 0 and finish is not null")
    # ranges of virtual time; all past 2 is far behind the cut, which lies at 1
    place = F.least("finish", F.lit(2.0)) * TIME_RANGES
    packets = packets.withColumn("time", F.floor(place)).withColumn("part", F.floor((place - F.floor(place)) * TIME_RANGES))

    def edge_of(rows: DataFrame, by: str, before: int):
        """The range in which the budget is reached, and the words served before it: of at most 2 * TIME_RANGES ranges."""
        served = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        sums = rows.groupBy(by).agg(F.sum("words").alias("words")).withColumn("served", F.sum("words").over(served) + before)
        return sums.filter(F.col("served") >= budget).orderBy(by).select(by, (F.col("served") - F.col("words")).alias("before")).first()

    edge = edge_of(packets, "time", 0)
    taken = F.lit(0).cast("long")
    if budget and edge is not None:
        packets = packets.filter(F.col("time") == edge["time"])
        edge = edge_of(packets, "part", edge["before"])
        order = Window.partitionBy("part").orderBy("finish", "shuffle", "first").rowsBetween(Window.unboundedPreceding, 0)
        cut = packets.filter(F.col("part") == edge["part"]).withColumn("served", F.sum("words").over(order) + edge["before"]).filter(F.col("served") >= budget).orderBy("served").first()
        for first, words, finish in _packets():
            tie = (finish == F.lit(cut["finish"])) & (F.col("shuffle") == F.lit(cut["shuffle"]))
            sooner = (finish < F.lit(cut["finish"])) | ((finish == F.lit(cut["finish"])) & (F.col("shuffle") < F.lit(cut["shuffle"]))) | (tie & (first < F.lit(cut["first"])))
            last = tie & (first == F.lit(cut["first"]))
            taken = taken + F.when(sooner, words).when(last, F.least(words, words - F.lit(cut["served"] - budget))).otherwise(F.lit(0))
    elif budget:  # every packet fits
        for _, words, finish in _packets():
            taken = taken + F.when(finish.isNotNull(), words).otherwise(F.lit(0))
    return queued.withColumn("taken", taken.cast("long")).drop("ahead")


#: Types whose values settle which of several repeated rows stands for them.
_PLAIN = ("string", "bigint", "int", "smallint", "tinyint", "double", "float", "boolean", "date", "timestamp", "binary")


def apply_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed documents themselves, with the input's columns: a document once for each whole time it is taken, and
    once cut after the words of a partial take. n_chars, where there is such a column, follows the text.

    Repeated rows (equal in key, text and source) share what is taken of them; where their other columns differ, one
    of them stands for all."""
    seed = options.get("seed", 7)
    taken = mix(docs, key, text, source, **options).groupBy("key", "shuffle", "source").agg(F.sum("taken").alias("_taken"), F.max("size").alias("_size"))
    columns = docs.columns
    hashed = docs.withColumn("_shuffle", shuffled(F.col(key), F.col(text), seed))
    one = Window.partitionBy(key, "_shuffle", source).orderBy(*[F.col(c).asc_nulls_last() for c in docs.columns if c not in (key, text, source) and dict(docs.dtypes)[c] in _PLAIN] or [F.lit(0)])
    d, t = hashed.withColumn("_row", F.row_number().over(one)).filter("_row = 1").alias("d"), taken.alias("t")
    joined = d.join(t, F.col(f"d.{key}").eqNullSafe(F.col("t.key")) & (F.col("d._shuffle") == F.col("t.shuffle")) & F.col(f"d.{source}").eqNullSafe(F.col("t.source"))).filter("_taken > 0")
    whole, rest = F.floor(F.col("_taken") / F.col("_size")).cast("int"), (F.col("_taken") % F.col("_size")).cast("int")
    joined = joined.withColumn("_words", F.explode(F.concat(F.array_repeat(F.lit(-1), whole), F.array_repeat(rest, F.when(rest > 0, 1).otherwise(0)))))
    pieces = F.regexp_extract_all(F.col(f"d.{text}"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.when(F.col("_words") < 0, F.col(f"d.{text}")).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.col("_words"), F.lit(0))), ""))
    out = joined.withColumn("_text", cut)
    return out.select(*[F.col("_text").alias(c) if c == text else F.length("_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"d.{c}") for c in columns])
