"""Content addresses: canonical JSON text and its hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(value: Column) -> Column:
    """A JSON string literal with non-ASCII characters as lower-case \\u escapes."""
    quoted = F.to_json(F.struct(value.alias("v")))
    literal = F.substring(quoted, F.lit(6), F.length(quoted) - 6)
    odd = F.array_distinct(F.regexp_extract_all(value, F.lit(r"[^\x00-\x7F]"), F.lit(0)))

    def escape(text: Column, ch: Column) -> Column:
        units = F.lower(F.hex(F.encode(ch, "UTF-16BE")))
        return F.replace(text, ch, F.regexp_replace(units, r"([0-9a-f]{4})", r"\\u$1"))

    return F.aggregate(odd, literal, escape)


def json_map(entries: Column) -> Column:
    """A JSON object of a string map, keys sorted."""
    pairs = F.transform(
        F.sort_array(F.map_entries(entries)), lambda e: F.concat(json_text(e["key"]), F.lit(": "), json_text(e["value"]))
    )
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def content_hash(content: Column, memory_type: Column, metadata: Column | None = None) -> Column:
    """SHA-256 of the canonical JSON of content, metadata (string map) and type."""
    meta = F.lit("{}") if metadata is None else F.coalesce(json_map(metadata), F.lit("{}"))
    text = F.concat(
        F.lit('{"content": '), json_text(content),
        F.lit(', "memory_type": '), json_text(memory_type),
        F.lit(', "metadata": '), meta, F.lit("}"),
    )
    return F.sha2(text, 256)


def edge_hash(source: Column, target: Column, edge_type: Column, weight: Column) -> Column:
    """SHA-256 of the canonical JSON of an edge; the weight is rounded to six places."""
    text = F.concat(
        F.lit('{"edge_type": '), json_text(edge_type),
        F.lit(', "source": '), json_text(source),
        F.lit(', "target": '), json_text(target),
        F.lit(', "weight": '), F.round(weight, 6).cast("string"), F.lit("}"),
    )
    return F.sha2(text, 256)


def clock_merge(a: Column, b: Column) -> Column:
    """Point-wise maximum of two vector clocks (map node -> counter)."""
    return F.map_zip_with(a, b, lambda _k, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def clock_le(a: Column, b: Column) -> Column:
    """a happened before b or equals it."""
    return F.forall(F.map_entries(a), lambda e: e["value"] <= F.coalesce(F.try_element_at(b, e["key"]), F.lit(0)))


def clock_order(a: Column, b: Column) -> Column:
    """before | after | equal | concurrent."""
    le, ge = clock_le(a, b), clock_le(b, a)
    return F.when(le & ge, "equal").when(le, "before").when(ge, "after").otherwise("concurrent")
