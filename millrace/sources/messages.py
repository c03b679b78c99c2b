"""Decoding of message columns: bodies, headers and instants."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .html import rendered

#: A message whose payload has been opened: its leaves in order, and the headers of its root.
RAW_MESSAGE = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("threadId", T.StringType()), T.StructField("internalDate", T.StringType()),
    T.StructField("headers", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))),
    T.StructField("parts", T.ArrayType(T.StructType([T.StructField("mime_type", T.StringType()), T.StructField("data", T.StringType())]))),
])
_HEADERS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_PARTS = pa.list_(pa.struct([("mime_type", pa.string()), ("data", pa.string())]))


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def _leaves(node: dict) -> list[dict]:
    """Nodes without parts, depth first; the walk keeps its own stack, as nesting has no limit."""
    found, stack = [], [node]
    while stack:
        at = stack.pop()
        inner = at.get("parts") or []
        inner = inner if isinstance(inner, list) else []
        stack.extend(x for x in reversed(inner) if isinstance(x, dict))
        if not inner:
            body = at.get("body")
            found.append({"mime_type": _text(at.get("mimeType")), "data": _text(body.get("data")) if isinstance(body, dict) else None})
    return found


def _node(text: str | None) -> dict | None:
    try:
        node = json.loads(text or "null")
    except (ValueError, RecursionError):
        return None
    return node if isinstance(node, dict) else None


def leaf_parts(payload: Column) -> Column:
    """The leaves of a message payload in JSON, in order, as RAW_MESSAGE has them; null and malformed JSON have none."""

    @F.arrow_udf("array<struct<mime_type: string, data: string>>")
    def read(column: pa.Array) -> pa.Array:
        return pa.array([_leaves(node) if (node := _node(text)) is not None else [] for text in column.to_pylist()], _PARTS)

    return read(payload)


def opened(payload: Column) -> Column:
    """struct(headers, parts) of a message payload in JSON, the headers of its root and its leaves; null where it is no JSON object."""

    @F.arrow_udf("struct<headers: array<struct<name: string, value: string>>, parts: array<struct<mime_type: string, data: string>>>")
    def read(column: pa.Array) -> pa.Array:
        out = []
        for text in column.to_pylist():
            if (node := _node(text)) is not None:
                heads = node.get("headers")
                heads = [{"name": _text(h.get("name")), "value": _text(h.get("value"))} for h in heads if isinstance(h, dict)] if isinstance(heads, list) else []
                node = {"headers": heads, "parts": _leaves(node)}
            out.append(node)
        return pa.array(out, pa.struct([("headers", _HEADERS), ("parts", _PARTS)]))

    return read(payload)


def _figures(data: Column) -> Column:
    """The characters of base64url data that carry bits."""
    return F.regexp_replace(F.translate(data, "-_", "+/"), "[^A-Za-z0-9+/]", "")


def is_broken(data: Column) -> Column:
    """Whether base64url data ends in the middle of a byte."""
    return F.coalesce(F.length(_figures(data)) % 4 == 1, F.lit(False))


def decoded(data: Column) -> Column:
    """Text of a base64url body, padded or not; characters of no alphabet are passed over, bytes that are no UTF-8 are replaced, and broken data is null."""
    figures = F.when(~is_broken(data), _figures(data))
    return F.make_valid_utf8(F.unbase64(F.rpad(figures, F.ceil(F.length(figures) / 4).cast("int") * 4, F.lit("="))).cast("string"))


def body(parts: Column, mime: str) -> Column:
    texts = F.filter(F.transform(F.filter(parts, lambda p: p["mime_type"] == mime), lambda p: decoded(p["data"])), lambda t: t != "")
    return F.try_element_at(texts, F.lit(1))


def header(headers: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(1))["value"], F.lit(""))


def instant(internal_date: Column) -> Column:
    """The instant of epoch milliseconds in a string, that of 0 for none; null for a string that is no number."""
    return F.timestamp_millis(F.when(internal_date.isNull(), F.lit(0)).otherwise(internal_date.try_cast("long")))


def text_links(text: Column) -> Column:
    """URLs in plain text, each once, without closing punctuation."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"https?://\S+"), F.lit(0)), lambda u: F.regexp_replace(u, r"[).,>\"']+$", "")))


def content_hash(message_id: Column, subject: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws(":", message_id, subject, text), 256)


def normalized(raw, *more: str):
    """RAW_MESSAGE rows, and their columns named in `more`, with sender, subject, received_at, plain_text, html and links; html-only messages have the rendered html as text.

    Links are those of the html, else those in the text. A message whose date is no number has received_at null: it can't be read.
    """
    plain, page = body(F.col("parts"), "text/plain"), body(F.col("parts"), "text/html")
    rows = raw.withColumn("_page", rendered(page))
    text = F.coalesce(plain, F.col("_page.text"), F.lit(""))
    links = F.when(F.size("_page.links") > 0, F.col("_page.links")).otherwise(F.transform(text_links(text), lambda u: F.struct(u.alias("url"), F.lit("").alias("anchor_text"))))
    return rows.select(
        *more, F.col("id").alias("message_id"), F.col("threadId").alias("thread_id"), header(F.col("headers"), "From").alias("sender"), header(F.col("headers"), "Subject").alias("subject"),
        instant(F.col("internalDate")).alias("received_at"), text.alias("plain_text"), page.alias("html"), links.alias("links"),
    )
