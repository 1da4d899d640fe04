"""Nested message payloads.

A payload is a part tree of unknown depth.  It is walked inside its own row by higher-order
functions over VARIANT: no explode, no shuffle, no depth limit.  A tree is never larger than
the message that carries it.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from heedline.functions.text import col, filled, from_base64url, is_document_name, let, or_empty, utf8

_HEADERS = "array<struct<name:string,value:string>>"
# Wide enough for any array position, so that paths sort in document order.
_POSITION_DIGITS = 10


def headers_of(payload: Column | str) -> Column:
    found = F.try_variant_get(col(payload), "$.headers", _HEADERS)
    return F.coalesce(found, F.array().cast(_HEADERS))


def first_header(headers: Column, name: str) -> Column:
    """Value of the first header of that name, any case."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def header_map(headers: Column) -> Column:
    """name -> value, the last duplicate wins (N4; needs mapKeyDedupPolicy=LAST_WIN)."""
    return F.map_from_entries(headers)


def header_or(headers: Column, name: str, default: str) -> Column:
    return F.coalesce(F.try_element_at(header_map(headers), F.lit(name)), F.lit(default))


def _node(path: Column, node: Column) -> Column:
    """The fields of one part that anything downstream reads."""
    return F.struct(
        path.alias("path"),
        F.try_variant_get(node, "$.mimeType", "string").alias("mime"),
        F.try_variant_get(node, "$.filename", "string").alias("filename"),
        F.try_variant_get(node, "$.body.data", "string").alias("data"),
        F.try_variant_get(node, "$.body.attachmentId", "string").alias("attachment_id"),
        F.try_variant_get(node, "$.body.size", "bigint").alias("size"),
        F.try_variant_get(node, "$.parts", "variant").isNull().alias("is_leaf"),
    )


def part_tree(payload: Column | str, json: Column | str) -> Column:
    """All parts, depth first, as array<struct<path, mime, filename, data, ...>>.

    ``json`` is the text the VARIANT was read from (or its to_json).  One fold step per nesting
    level.  Every level opens a JSON array, so the number of '[' in the text bounds the depth;
    steps past the last level see an empty frontier.
    """
    text = col(json)
    depth = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("["), F.lit("")))
    levels = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    no_parts = F.array().cast("array<variant>")

    def children(parent: Column) -> Column:
        parts = F.coalesce(F.try_variant_get(parent["node"], "$.parts", "array<variant>"), no_parts)
        return F.transform(
            parts,
            lambda part, i: F.struct(
                F.concat(parent["path"], F.lpad(i.cast("string"), _POSITION_DIGITS, "0")).alias("path"),
                part.alias("node"),
            ),
        )

    def with_level(parts: Column, level: Column) -> Column:
        fields = F.transform(level, lambda n: _node(n["path"], n["node"]))
        return F.struct(level.alias("frontier"), F.concat(parts, fields).alias("parts"))

    def step(state: Column, _: Column) -> Column:
        level = F.flatten(F.transform(state["frontier"], children))
        return let(level, lambda nodes: with_level(state["parts"], nodes))

    def walk(root: Column) -> Column:
        start = F.struct(F.lit("").alias("path"), root.alias("node"))
        initial = F.struct(
            F.array(start).alias("frontier"), F.array(_node(F.lit(""), root)).alias("parts")
        )
        walked = F.aggregate(levels, initial, step, lambda state: state["parts"])
        return F.when(root.isNotNull(), F.sort_array(walked))

    return let(col(payload), walk)


def first_body(parts: Column, mime: str, unless: str | None = None) -> Column:
    """Decoded text of the first non-empty part of a type, in document order."""

    def matches(p: Column) -> Column:
        hit = filled(p["data"]).isNotNull() & F.contains(or_empty(p["mime"]), F.lit(mime))
        return hit & ~F.contains(or_empty(p["mime"]), F.lit(unless)) if unless else hit

    bodies = F.transform(F.filter(parts, matches), lambda p: utf8(from_base64url(p["data"])))
    return F.get(F.filter(bodies, lambda text: text != ""), F.lit(0))


def body_text(parts: Column) -> Column:
    return first_body(parts, "text/plain")


def body_html(parts: Column) -> Column:
    return first_body(parts, "text/html", unless="text/plain")


def attachment_refs(parts: Column) -> Column:
    """Document attachments in order: leaves with a document name and an attachment id."""
    wanted = F.filter(
        parts,
        lambda p: p["is_leaf"]
        & is_document_name(p["filename"])
        & filled(p["attachment_id"]).isNotNull(),
    )
    return F.transform(
        wanted,
        lambda p: F.struct(
            p["attachment_id"].alias("attachment_id"),
            p["filename"].alias("filename"),
            F.coalesce(p["size"], F.lit(0)).alias("size"),
            p["path"].alias("part_path"),
        ),
    )


def labels_to_json(labels: Column | str) -> Column:
    """Label list to JSON text; no list is an empty one."""
    return F.to_json(F.coalesce(col(labels), F.array().cast("array<string>")))


def labels_from_json(text: Column | str) -> Column:
    return F.from_json(col(text), "array<string>")
