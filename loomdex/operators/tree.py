"""Markup as a tree of nodes: parsing, navigation and deep text, one document at a time inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..scratch import narrow

#: Tags whose own text is left out of a page's body.
BLOCKED = ("style", "a")


@dataclass
class Node:
    parent: int
    ord: int
    depth: int
    tag: str
    closed: bool = False
    data: list[str] = field(default_factory=list)
    attrs: list[tuple[str, str | None]] = field(default_factory=list)
    children: list[int] = field(default_factory=list)


def _attributes(inside: str) -> list[tuple[str, str | None]]:
    """name="value" with either quote closing; blanks and tabs within values go; a bare name counts (with null) only if
    another attribute follows; after an unquoted value all is skipped up to the next quote."""
    out: list[tuple[str, str | None]] = []
    pending, name, i, n = None, "", 0, len(inside)
    while i < n:
        c = inside[i]
        if c == "=":
            start = min((p for p in (inside.find('"', i), inside.find("'", i)) if p >= 0), default=-1)
            if start < 0:
                return out
            end = min((p for p in (inside.find('"', start + 1), inside.find("'", start + 1)) if p >= 0), default=n)
            if pending:
                out.append((pending, None))
                pending = None
            out.append((name or "", inside[start + 1 : end].replace(" ", "").replace("\t", "")))
            name, i = "", end + 1
            continue
        if c in " \t/":
            if name:
                if pending:
                    out.append((pending, None))
                pending, name = name, ""
        else:
            name += c
        i += 1
    return out


def parse(text: str, newline: str = "") -> list[Node]:
    """Nodes in document order; node 0 is the root that wraps all.

    `<` always starts a tag.  A close tag pops one level whatever its name, never the root.  A node's data has a `<`
    where a child stands; self-closing children have none and are not descended into.  Comments leave a `>`.  Line breaks
    become `newline` (nothing, as the index has it).
    """
    text = text.replace("\n", newline)
    nodes, at, i, n = [Node(-1, 0, 0, "root")], 0, 0, len(text)
    while i < n:
        j = text.find("<", i)
        if j < 0:
            nodes[at].data.append(text[i:])
            break
        if j > i:
            nodes[at].data.append(text[i:j])
        if text.startswith("<!--", j):
            end = text.find("-->", j + 4)
            if end < 0:
                break
            nodes[at].data.append(">")
            i = end + 3
            continue
        if text.startswith("/", j + 1):
            end = text.find(">", j)
            at = max(0, nodes[at].parent) if at else 0
            if end < 0:
                break
            i = end + 1
            continue
        end, quote = j + 1, ""
        while end < n and (quote or text[end] != ">"):
            c = text[end]
            if quote:
                quote = "" if c in "\"'" else quote
            elif c in "\"'" and "=" in text[j:end]:
                quote = c
            end += 1
        inside = text[j + 1 : end]
        tag = inside.split(" ", 1)[0]
        closed = inside.endswith("/")
        parent = nodes[at]
        node = Node(at, len(parent.children), parent.depth + 1, tag, closed, attrs=_attributes(inside[len(tag) :]))
        parent.children.append(len(nodes))
        nodes.append(node)
        if not closed:
            parent.data.append("<")
            at = len(nodes) - 1
        i = end + 1
    return nodes


def deep_text(nodes: list[Node], start: int = 0, blocked: tuple[str, ...] = (), mode: str = "observed") -> str:
    """A node's text with each child's deep text at its `<`, and one blank after a child that gave text without a final
    one.  A blocked node's own text is left out, its children's is not.  observed: the i-th `<` stands for the i-th child,
    self-closing ones counted (so that later children shift); intended: for the i-th child that has a place."""
    done: dict[int, str] = {}
    for k in range(len(nodes) - 1, start - 1, -1):
        node = nodes[k]
        kids = node.children if mode == "observed" else [c for c in node.children if not nodes[c].closed]
        out, place = [], 0
        for piece in node.data:
            if piece == "<":
                t = done.get(kids[place], "") if place < len(kids) else ""
                place += 1
                out.append(t + " " if t and not t.endswith(" ") else t)
            elif node.tag not in blocked:
                out.append(piece)
        done[k] = "".join(out)
        for c in node.children:
            done.pop(c, None)
    return done[start]


def first_by_tag(nodes: list[Node], tag: str, start: int = 0) -> int:
    """The first node of a tag: all children of a node are tested before the first child's children; -1 if none."""
    stack = [start]
    while stack:
        here = stack.pop()
        for c in nodes[here].children:
            if nodes[c].tag == tag:
                return c
        stack += reversed(nodes[here].children)
    return -1


def all_by_tag(nodes: list[Node], tag: str, include_start: bool = False) -> list[int]:
    """All nodes of a tag in document order."""
    return [k for k, x in enumerate(nodes) if x.tag == tag and (include_start or k)]


def _map(docs: DataFrame, id_col: str, text_col: str, schema: str, rows: object) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [x for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if t is not None for x in rows(i, t)]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return narrow(docs, doc_id=F.col(f"`{id_col}`").cast("string"), text=F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema)


def page_nodes(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(doc_id, node_id, parent_id, ord, depth, tag, data, attrs) of every text; null texts have no nodes."""

    def rows(i: str, text: str) -> list[dict]:
        return [{"doc_id": i, "node_id": k, "parent_id": x.parent, "ord": x.ord, "depth": x.depth, "tag": x.tag, "data": "".join(x.data), "attrs": [{"name": a, "value": v} for a, v in x.attrs]} for k, x in enumerate(parse(text))]

    return _map(docs, id_col, text_col, "doc_id string, node_id int, parent_id int, ord int, depth int, tag string, data string, attrs array<struct<name:string,value:string>>", rows)


def page_text(docs: DataFrame, id_col: str = "id", text_col: str = "text", blocked: tuple[str, ...] = BLOCKED, mode: str = "observed", newline: str = "") -> DataFrame:
    """(doc_id, body): the deep text of every text, without the own text of blocked tags."""
    return _map(docs, id_col, text_col, "doc_id string, body string", lambda i, t: [{"doc_id": i, "body": deep_text(parse(t, newline), 0, blocked, mode)}])


def page_fields(files: DataFrame, text_col: str = "value", mode: str = "observed") -> DataFrame:
    """(id, title, text) of every page of marked-up files, pages being the nodes of tag `page` (or the whole file if it
    has none); of each, the first node of tag id, title and text.  Pages without one of the three are dropped."""

    def rows(_: str, text: str) -> list[dict]:
        nodes = parse(text)
        out = []
        for p in all_by_tag(nodes, "page") or [0]:
            at = {t: first_by_tag(nodes, t, p) for t in ("id", "title", "text")}
            if min(at.values()) > 0:
                out.append({t: deep_text(_below(nodes, k), 0, BLOCKED if t == "text" else (), mode) for t, k in at.items()})
        return out

    return _map(files.withColumn("_n", F.lit("")), "_n", text_col, "id string, title string, text string", rows)


def _below(nodes: list[Node], start: int) -> list[Node]:
    """A node and its descendants as a tree of their own."""
    keep = [start]
    for k in keep:
        keep += nodes[k].children
    keep.sort()
    new = {k: i for i, k in enumerate(keep)}
    return [Node(new.get(nodes[k].parent, -1), nodes[k].ord, nodes[k].depth, nodes[k].tag, nodes[k].closed, nodes[k].data, nodes[k].attrs, [new[c] for c in nodes[k].children]) for k in keep]


def children(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, kids): the children of each node in order."""
    w = nodes.where("parent_id >= 0").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("node_id").alias("k")))), lambda x: x["k"]).alias("kids"))
    return w


def last_child(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, last): the last child of each node that has one."""
    return nodes.where("parent_id >= 0").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.max_by("node_id", "ord").alias("last"))


def first_of_tag(nodes: DataFrame, tag: str) -> DataFrame:
    """(doc_id, node_id): first_by_tag() of every document that has the tag: the parent that comes first decides, then the
    place among its children."""
    return nodes.where((F.col("tag") == tag) & (F.col("parent_id") >= 0)).groupBy("doc_id").agg(F.min_by("node_id", F.struct("parent_id", "ord")).alias("node_id"))


def all_of_tag(nodes: DataFrame, tag: str) -> DataFrame:
    """(doc_id, nodes): all nodes of a tag in document order, of every document that has any."""
    return nodes.where((F.col("tag") == tag) & (F.col("parent_id") >= 0)).groupBy("doc_id").agg(F.sort_array(F.collect_list("node_id")).alias("nodes"))


def data_by_tag(nodes: DataFrame, tag: str) -> DataFrame:
    """(doc_id, n, data): own text of every node of a tag in document order, start node included."""
    w = Window.partitionBy("doc_id").orderBy("node_id")
    return nodes.where(F.col("tag") == tag).select("doc_id", F.row_number().over(w).alias("n"), "data")


def strip_comments(text: str) -> object:
    """A column without comments; each leaves a `>`."""
    return F.regexp_replace(F.col(text), r"(?s)<!--.*?-->", ">")
