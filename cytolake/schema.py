"""The table of cytosine sites and its text report formats.

strand: true +, false -, null unknown. context: true CG, false CHG, null CHH; null is a value, so comparisons are
null-safe. density: methylated share of reads; NaN where there are no reads, null where it is unknown. position counts
from 1. Intervals are half-open where they are asked for overlap: start < other end and end > other start.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

SITE = T.StructType(
    [
        T.StructField("chr", T.StringType(), False),
        T.StructField("position", T.LongType(), False),
        T.StructField("strand", T.BooleanType()),
        T.StructField("context", T.BooleanType()),
        T.StructField("count_m", T.LongType()),
        T.StructField("count_total", T.LongType()),
        T.StructField("density", T.DoubleType()),
    ]
)
SITE_COLUMNS = SITE.fieldNames()
INTERVAL = T.StructType([T.StructField("chr", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.DoubleType())])
CONTIG = T.StructType([T.StructField("seqname", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("strand", T.BooleanType())])
#: Positions are 32-bit in files.
MAX_POSITION = 2**32 - 1


@dataclass(frozen=True)
class ReportType:
    """A text format: tab-separated, no header; skip counts lines before the first row."""

    name: str
    ddl: str
    aligned: bool  # needs a genome to supply strand and context
    skip: int = 0
    position: str = "position"
    strand: str | None = None
    context: str | None = None

    @property
    def schema(self) -> T.StructType:
        return T._parse_datatype_string(self.ddl)

    @property
    def columns(self) -> list[str]:
        return [c.split()[0] for c in self.ddl.split(", ")]


REPORTS = {
    r.name: r
    for r in (
        ReportType("bismark", "chr string, position long, strand string, count_m long, count_um long, context string, trinuc string", False, strand="strand", context="context"),
        ReportType("cgmap", "chr string, nuc string, position long, context string, dinuc string, density double, count_m long, count_total long", False, strand="nuc", context="context"),
        ReportType("bedgraph", "chr string, start long, end long, density double", True, 1, "start"),
        ReportType("coverage", "chr string, start long, end long, density double, count_m long, count_um long", True, position="start"),
    )
}
