"""Word files with the standard library: blocks in document order; sections by windows over the blocks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import folds
from folioflow.functions import text as X

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
HEADINGLESS_WORDS = 500


class Block(NamedTuple):
    """A paragraph (style, text) or a table (cells)."""

    style: str
    text: str
    cells: list[list[str]] | None = None


def _text(paragraph: ElementTree.Element) -> str:
    parts = []
    for node in paragraph.iter():
        if node.tag == W + "t":
            parts.append(node.text or "")
        elif node.tag == W + "tab":
            parts.append("\t")
        elif node.tag in (W + "br", W + "cr"):
            parts.append("\n")
    return "".join(parts)


def blocks(content: bytes) -> Iterator[Block]:
    """The body's paragraphs and tables; other children are skipped."""
    with zipfile.ZipFile(io.BytesIO(content)) as file:
        body = ElementTree.fromstring(file.read("word/document.xml")).find(W + "body")
        names = {}
        if "word/styles.xml" in file.namelist():
            for style in ElementTree.fromstring(file.read("word/styles.xml")).iter(W + "style"):
                name = style.find(W + "name")
                names[style.get(W + "styleId")] = name.get(W + "val") if name is not None else ""
    for child in body if body is not None else ():
        if child.tag == W + "p":
            style = child.find(f"{W}pPr/{W}pStyle")
            key = style.get(W + "val") if style is not None else ""
            yield Block(names.get(key, key) or "", _text(child))
        elif child.tag == W + "tbl":
            yield Block("", "", [["\n".join(_text(p) for p in cell.findall(W + "p")) for cell in row.findall(W + "tc")] for row in child.findall(W + "tr")])


#: The parts of a Word file but its body.
CONTENT_TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
RELATIONS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'


def written(parts: Iterable[Block]) -> bytes:
    """A Word file of blocks; the style's name is its id.  Text must be fit for XML."""

    def paragraph(text: str, style: str = "") -> str:
        named = f"<w:pPr><w:pStyle w:val={quoteattr(style)}/></w:pPr>" if style else ""
        return f'<w:p>{named}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'

    def table(cells: list[list[str]]) -> str:
        return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in row) + "</w:tr>" for row in cells) + "</w:tbl>"

    body = "".join(table(b.cells) if b.cells is not None else paragraph(b.text, b.style) for b in parts)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as file:
        for name, text in (("[Content_Types].xml", CONTENT_TYPES), ("_rels/.rels", RELATIONS), ("word/document.xml", f'<w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>')):
            file.writestr(zipfile.ZipInfo(name), text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def table_text(cells: Column) -> Column:
    """Rows on lines, cells between ` | `; of equal cells side by side one stays, as they are one merged cell."""
    plain = lambda row: F.transform(row, lambda c: F.array_join(X.words(c), " "))
    apart = lambda row: F.filter(row, lambda c, i: (i == 0) | (c != F.get(row, i - 1)))
    return F.array_join(F.transform(F.transform(cells, plain), lambda row: F.array_join(apart(row), " | ")), "\n")


def is_heading(style: Column) -> Column:
    return F.lower(style).startswith("heading") | (F.lower(style) == "title")


def sections(rows: DataFrame, most_words: int = HEADINGLESS_WORDS) -> DataFrame:
    """(doc_id, doc_name, seg_no, section, text) of blocks (doc_id, doc_name, block_no, style, text, cells).

    Blocks without text don't count.  A heading begins a section and is its first paragraph; what stands before the
    first heading is cut where `most_words` words are reached, and named by the numbers of its blocks."""
    order = Window.partitionBy("doc_id").orderBy("block_no")
    text = F.when(F.col("cells").isNull(), X.strip(F.coalesce("text", F.lit("")))).otherwise(table_text(F.col("cells")))
    full = rows.select("doc_id", "doc_name", "block_no", (is_heading(F.col("style")) & F.col("cells").isNull()).alias("head"), text.alias("text")).where("text <> ''")
    placed = full.withColumn("number", F.row_number().over(order)).withColumn("headings", F.sum(F.col("head").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # Blocks meet by section in the task that numbered them; the first cuts are runs of its list, so nothing is joined.
    ordered = F.array_sort(F.collect_list(F.struct("number", "text")))
    whole = placed.groupBy("doc_id", "headings").agg(F.first("doc_name").alias("doc_name"), ordered.alias("b"))
    sizes = F.when(F.col("headings") == 0, F.transform("b", lambda x: F.size(X.words(x["text"]))))
    runs = F.transform(folds.reaching_runs(sizes, most_words), lambda r: F.slice(F.col("b"), r["first"] + 1, r["n"]))
    cut = whole.select("doc_id", "doc_name", "headings", F.explode(F.coalesce(runs, F.array("b"))).alias("b"))
    found = cut.select("doc_id", "doc_name", "headings", "b", F.col("b")[0]["text"].alias("first"), F.col("b")[0]["number"].alias("lo"), F.element_at("b", -1)["number"].alias("hi"))
    label = F.when(F.col("headings") > 0, F.col("first")).otherwise(F.format_string("paras %d-%d", "lo", "hi"))
    seg_no = F.row_number().over(Window.partitionBy("doc_id").orderBy("lo")) - 1
    return found.select("doc_id", "doc_name", seg_no.alias("seg_no"), label.alias("section"), F.array_join("b.text", "\n\n").alias("text"))
