"""Texts of the wire: array bodies, header blocks, key/value lines, requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_array(body: str | Column) -> Column:
    """Items of `["a", "b", c]`: split at commas outside quotes; quotes and opening brackets go, blanks stay, the text
    ends at the first closing bracket outside quotes.  `[]` gives one empty string, null gives null."""
    inside = F.regexp_extract(_col(body), r'^[^"\]]*(?:"[^"]*"[^"\]]*)*', 0)
    commas = F.regexp_replace(inside, r'"([^"]*)"', "\u0002$1\u0003")
    # commas between quotes are masked while the text is split
    masked = F.array_join(F.transform(F.split(commas, "\u0003", -1), lambda p: F.when(F.contains(p, F.lit("\u0002")), F.concat(F.split_part(p, F.lit("\u0002"), F.lit(1)), F.translate(F.split_part(p, F.lit("\u0002"), F.lit(2)), ",", "\u0001"))).otherwise(p)), "")
    return F.when(_col(body).isNotNull(), F.transform(F.split(masked, ",", -1), lambda p: F.translate(p, "\u0001[", ",")))


def parse_array_clean(body: str | Column) -> Column:
    """The same body as well-formed JSON: items as strings without outer blanks; null where it is not well-formed."""
    return F.from_json(_col(body), "array<string>")


def parse_headers(block: str | Column) -> Column:
    """A header block without its status line as a map; the first of repeated names holds.  Lines without a colon fall away."""
    lines = F.filter(F.slice(F.split(_col(block), "\r?\n"), 2, 1 << 20), lambda x: x.rlike("^[^:]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    return F.map_from_entries(first)


def parse_response(text: str | Column) -> Column:
    """struct(status, headers, body, body_len) of a whole response."""
    c = _col(text)
    head = F.regexp_extract(c, r"(?s)^(.*?)\r?\n\r?\n", 1)
    body = F.regexp_replace(c, r"(?s)^.*?\r?\n\r?\n", "")
    return F.struct(F.split_part(head, F.lit("\n"), F.lit(1)).alias("status"), parse_headers(head).alias("headers"), body.alias("body"), F.length(body).alias("body_len"))


def parse_kv(line: str | Column) -> Column:
    """struct(key, value) of `key|value`; the value is what follows the first bar, null without one."""
    c = _col(line)
    return F.struct(F.split_part(c, F.lit("|"), F.lit(1)).alias("key"), F.when(F.instr(c, "|") > 0, F.substring(c, F.instr(c, "|") + 1, F.length(c))).alias("value"))


def request_text(host: str, path: str | Column, body: str | Column | None = None) -> Column:
    """A request: POST with a form body, or GET without one; the length is that of the body in bytes."""
    p = F.lit(path) if isinstance(path, str) else path
    if body is None:
        return F.concat(F.lit("GET "), p, F.lit(f" HTTP/1.1\r\nHost: {host}\r\nContent-Type: text/plain\r\n\r\n"))
    b = F.lit(body) if isinstance(body, str) else body
    return F.concat(F.lit("POST "), p, F.lit(f" HTTP/1.1\r\nHost: {host}\r\nContent-Type: application/x-www-form-urlencoded\r\nContent-Length: "), F.octet_length(b).cast("string"), F.lit("\r\n\r\n"), b)
