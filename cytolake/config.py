"""Parsing of option values."""

from __future__ import annotations

from dataclasses import dataclass

from cytolake.schema import REPORTS, ReportType

COMPRESSIONS = {"none": "", "gz": "gzip", "gzip": "gzip", "zst": "zstd", "zstd": "zstd", "lz4": "lz4", "xz": "xz", "xz2": "xz", "lzma": "xz", "bz2": "bzip2", "bzip2": "bzip2", "zip": "zip"}
AGGREGATES = ("mean", "sum", "gmean", "median", "max", "min")
ADJUSTMENTS = ("bh", "by", "bonf", "none")


def report_type(name: str) -> ReportType:
    if name.lower() not in REPORTS:
        raise ValueError(f"unknown report type {name!r}: one of {', '.join(REPORTS)}")
    return REPORTS[name.lower()]


def compression(name: str | None) -> str:
    """The codec's canonical name; an empty string for none."""
    if (name or "none").lower() not in COMPRESSIONS:
        raise ValueError(f"unknown compression {name!r}")
    return COMPRESSIONS[(name or "none").lower()]


def aggregate(name: str) -> str:
    found = {"geometricmean": "gmean", "geometric_mean": "gmean", "geometric-mean": "gmean", "avg": "mean"}.get(name.lower(), name.lower())
    if found not in AGGREGATES:
        raise ValueError(f"unknown aggregate {name!r}: one of {', '.join(AGGREGATES)}")
    return found


def adjustment(name: str) -> str:
    found = {"bonferroni": "bonf", "benjamini-hochberg": "bh", "benjamini-yekutieli": "by"}.get(name.lower(), name.lower())
    if found not in ADJUSTMENTS:
        raise ValueError(f"unknown adjustment {name!r}: one of {', '.join(ADJUSTMENTS)}")
    return found


@dataclass(frozen=True)
class MergeType:
    kind: str = "full"
    eps: float = 0.0
    min_points: int = 1
    max_dist: int = 0
    agg: str = "mean"


def merge_type(text: str) -> MergeType:
    """full, or dbscan:eps:min_points:max_dist:aggregate."""
    head, *rest = text.split(":")
    if head.lower() == "full" and not rest:
        return MergeType()
    if head.lower() == "dbscan" and len(rest) == 4:
        return MergeType("dbscan", float(rest[0]), int(rest[1]), int(rest[2]), aggregate(rest[3]))
    raise ValueError(f"unknown merge type {text!r}")
