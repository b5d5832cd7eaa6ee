"""GFF attributes: text to struct and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Attributes with a field of their own, in the order in which they are written; lists but for id.
#: (fixed values)
NAMED = (("ID", "id"), ("Name", "name"), ("Alias", "alias"), ("Parent", "parent"), ("Target", "target"), ("Gap", "gap"), ("Derives_from", "derives_from"), ("Note", "note"), ("Dbxref", "dbxref"), ("Ontology_term", "ontology_term"))
_LISTS = {"name", "alias", "parent", "note", "dbxref", "ontology_term"}


def attributes(text: Column) -> Column:
    """STRUCT of the named attributes and the map other. Pairs are split at ';', at the first '=', lists at ','.
    Target is ignored; a missing attribute is null."""
    pairs = F.map_filter(F.str_to_map(F.coalesce(text, F.lit("")), F.lit(";"), F.lit("=")), lambda k, v: (k != "") & v.isNotNull())
    fields = []
    for key, name in NAMED:
        value = pairs[F.lit(key)]
        if name == "target":
            continue
        fields.append((F.split(value, ",") if name in _LISTS else value).alias(name))
    known = F.array(*[F.lit(k) for k, _ in NAMED])
    return F.struct(*fields, F.map_filter(pairs, lambda k, v: ~F.array_contains(known, k)).alias("other"))


def attributes_text(a: Column) -> Column:
    """ID first, then the named attributes in their order, then the others by key."""
    parts = []
    for key, name in NAMED:
        if name == "target":
            continue
        value = F.array_join(a[name], ",") if name in _LISTS else a[name]
        parts.append(F.concat(F.lit(f"{key}="), value))
    other = F.transform(F.array_sort(F.map_entries(a["other"])), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat_ws(";", F.filter(F.array(*parts), lambda x: x.isNotNull()), other)
