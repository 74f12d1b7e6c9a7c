"""Text nodes of web pages: what an answer shows outside of code, with placeholders put back.

Markup nests, so which nodes lie in code is a walk over a stack of open elements; it is the one thing here that
columns can't say, and runs a batch of pages at a time in Python. Putting back is the same column expression as for messages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import rehydrated

# Elements whose text is never touched, like those with the role of code.
CODE = ("code", "pre", "kbd", "samp", "textarea")
#: Elements without content, and those whose content is not markup.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
RAW = ("script", "style", "textarea", "title")
NODES = "array<struct<place:int,start:int,stop:int,text:string>>"

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.DOTALL)
_ROLE = re.compile(r"""(?:^|[\s"'/])role\s*=\s*(?:"code"|'code'|code(?=[\s/]|$))""", re.IGNORECASE)


def text_pieces(html: str) -> Iterator[tuple[int, int, str]]:
    """(start, stop, text) of the text nodes outside code, offsets in code points of the markup, text with its entities read.

    An end tag closes the innermost element of its name and all in it; without one it is nothing. What is
    open at the end of the page stays open. Scripts, styles and titles have no text nodes. A '<' that begins no tag is text.
    """
    stack: list[tuple[str, bool]] = []
    at, begun, size = 0, 0, len(html)

    def piece(start: int, stop: int) -> Iterator[tuple[int, int, str]]:
        if stop > start and not any(hidden for _, hidden in stack):
            yield start, stop, unescape(html[start:stop])

    while found := _TAG.search(html, at):
        yield from piece(begun, found.start())
        at = begun = found.end()
        name = (found["name"] or "").lower()
        if not name:
            continue
        if found["close"]:
            opened = [i for i, (n, _) in enumerate(stack) if n == name]
            if opened:
                del stack[opened[-1] :]
        elif name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
            at = begun = end.end() if end else size
        elif name not in VOID:
            stack.append((name, name in CODE or bool(_ROLE.search(found["rest"]))))
    yield from piece(begun, size)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("place", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("text", pa.string())]))
    for batch in batches:
        found = [[{"place": i, "start": a, "stop": b, "text": t} for i, (a, b, t) in enumerate(text_pieces(html.as_py() or ""))] for html in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array(found, kind)], names=["page", "nodes"])


def text_nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without ``html``, with nodes (NODES): the text nodes outside code. Null markup has none; rows may repeat."""
    rest = [c for c in pages.columns if c != html]
    packed = pages.select(F.struct(*rest).alias("page"), F.col(html).alias("html"))
    kind = packed.schema["page"].dataType.simpleString()
    return packed.mapInArrow(_nodes, f"page {kind}, nodes {NODES}").select("page.*", "nodes")


def restored_pages(pages: DataFrame, redaction_map: Column, html: str = "html") -> DataFrame:
    """Pages with their nodes restored: nodes, restored (number of placeholders put back), unresolved (distinct, in order), text.

    ``redaction_map`` is an array of (id, original) made of other columns. Each node is restored by itself.
    """
    told = text_nodes(pages.withColumn("_map", redaction_map), html)
    done = told.withColumn("_done", F.transform("nodes", lambda n: rehydrated(n["text"], F.col("_map"))))
    total = F.aggregate("_done", F.lit(0), lambda acc, d: acc + d["replaced"])
    missing = F.array_distinct(F.flatten(F.transform("_done", lambda d: d["unresolved"])))
    return done.select(*[c for c in pages.columns if c != html], "nodes", total.alias("restored"), missing.alias("unresolved"), F.array_join(F.transform("_done", lambda d: d["text"]), "").alias("text"))
