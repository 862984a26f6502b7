"""Tables and links of HTML pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspan.functions import text


class _Tables(HTMLParser):
    """Rows of cells (text, links) of every table, in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[dict] = []
        self.open: list[dict] = []
        self.cell: dict | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            t = {"classes": (a.get("class") or "").split(), "rows": []}
            self.tables.append(t)
            self.open.append(t)
            self.cell = None
        elif tag == "tr" and self.open:
            self.open[-1]["rows"].append([])
            self.cell = None
        elif tag in ("td", "th") and self.open:
            if not self.open[-1]["rows"]:
                self.open[-1]["rows"].append([])
            self.cell = {"text": [], "links": []}
            self.open[-1]["rows"][-1].append(self.cell)
        elif tag == "a" and self.cell is not None and a.get("href"):
            self.cell["links"].append(a["href"])

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.cell = None
        elif tag == "table" and self.open:
            self.open.pop()
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None and data.strip():
            self.cell["text"].append(data.strip())


def table_cells(pages: DataFrame, key: str, html: str, table_class: str, nth: int) -> DataFrame:
    """(key, row, cells array<struct<text,links>>) of the nth table of a class, the header row left out."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        schema = pa.schema([(key, batches_type(kind)), ("row", pa.int64()), ("cells", pa.list_(pa.struct([("text", pa.string()), ("links", pa.list_(pa.string()))])))])
        for b in batches:
            out = []
            for k, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = _Tables()
                p.feed(page or "")
                found = [t for t in p.tables if table_class in t["classes"]]
                if len(found) > nth:
                    for i, row in enumerate(found[nth]["rows"][1:]):
                        out.append({key: k, "row": i, "cells": [{"text": " ".join(c["text"]), "links": c["links"]} for c in row]})
            yield pa.RecordBatch.from_pylist(out, schema)

    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, row long, cells array<struct<text string, links array<string>>>")


def batches_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def ranked_rows(cells: DataFrame, key: str) -> DataFrame:
    """(key, row, name, length_km, titles): second cell's name and links, third cell's number."""
    name, length = F.try_element_at("cells", F.lit(2)), F.try_element_at("cells", F.lit(3))
    d = cells.filter(F.size("cells") >= 3).select(key, "row", text.without_footnotes(name["text"]).alias("name"), text.leading_integer(length["text"]).alias("length_km"), name["links"].alias("links"))
    titles = F.transform(F.filter("links", lambda h: h.startswith("/wiki/")), text.link_title)
    titles = F.array_distinct(F.filter(titles, lambda s: ~s.contains(":") & (s != "")))
    return d.select(key, "row", "name", "length_km", F.when(F.size(titles) > 0, titles).otherwise(F.array(F.translate("name", " ", "_"))).alias("titles"))


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, href) of the links of well-formed pages, in expressions alone."""
    found = F.regexp_extract_all(html, F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("pos", "href"))
