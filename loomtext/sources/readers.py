"""Readers: text files, bytes of unknown encoding, PDF pages and layout elements, HTML elements, sections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions.text import rx, strip

#: a PDF parser turns a file's bytes into (page_no, tag, text) elements in order
PdfParser = Callable[[bytes], list[tuple[int, str, str]]]

HEADINGS = ("heading", "title", "h1", "h2", "h3")
ELEMENTS = "path string, page_no int, pos int, tag string, text string"


def decoded(content: Column) -> Column:
    """UTF-8 bytes as text; other bytes as Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content")).alias("text"))


def pymupdf_pages(content: bytes) -> list[tuple[int, str, str]]:
    """Pages as plain text elements, if the PyMuPDF library is there."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        return [(i + 1, "page", page.get_text("text")) for i, page in enumerate(doc)]


def read_pdf_elements(spark: SparkSession, path: str, parser: PdfParser = pymupdf_pages) -> DataFrame:
    """(path, page_no, pos, tag, text) of PDF files by a parser that runs in tasks; a file that it can't read fails the task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                rows = [(name, page, i, tag, text) for i, (page, tag, text) in enumerate(parser(bytes(content)))]
                yield pd.DataFrame(rows, columns=["path", "page_no", "pos", "tag", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ELEMENTS)


def page_texts(elements: DataFrame) -> DataFrame:
    """(path, text): texts of all elements joined by line ends."""
    parts = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text"))))
    return elements.groupBy("path").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def html_elements(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(doc_id, pos, tag, text) of headings, paragraphs, list items and tables of HTML, tags within them dropped."""
    found = F.regexp_extract_all(F.col(html), F.lit(rx(r"<(h[1-6]|p|li|title|table)\b[^>]*>.*?</\1\s*>", "is")), 0)
    rows = pages.select(F.col(key).alias("doc_id"), F.posexplode(found).alias("pos", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"^<([A-Za-z0-9]+)", 1))
    return rows.select("doc_id", "pos", tag.alias("tag"), strip(F.regexp_replace("raw", "(?s)<[^>]*>", "")).alias("text"))


def element_sections(elements: DataFrame) -> DataFrame:
    """(doc_id, section_no, heading, text, formulas, tables) of ordered elements (doc_id, pos, tag, text).

    Headings open sections; formulas and tables stand in lists and in the text; the first heading is Abstract; sections without anything
    are left out, and the others counted from 0.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    tag, text = F.lower(F.coalesce("tag", F.lit(""))), F.coalesce("text", F.lit(""))
    opens = tag.isin(*HEADINGS)
    shown = F.when(tag == "formula", F.concat(F.lit("\n[Formula: "), text, F.lit("]\n"))).when(tag == "table", F.concat(F.lit("\n"), text, F.lit("\n"))).otherwise(strip(text))
    rows = elements.withColumn("group", F.sum(opens.cast("int")).over(order))
    some = F.when(tag.isin("formula", "table"), text).otherwise(strip(text)) != ""
    rows = rows.select("doc_id", "group", "pos", tag.alias("tag"), F.when(opens, strip(text)).alias("heading"), F.when(~opens & some, shown).alias("shown"), text.alias("raw"))
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when((F.col("tag") == kind) & F.col("shown").isNotNull(), F.struct("pos", "raw")))), lambda x: x["raw"])
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("shown").isNotNull(), F.struct("pos", "shown")))), lambda x: x["shown"])
    grouped = rows.groupBy("doc_id", "group").agg(F.max("heading").alias("heading"), F.size(parts).alias("n"), strip(F.array_join(parts, "\n")).alias("text"), listed("formula").alias("formulas"), listed("table").alias("tables"))
    grouped = grouped.filter("n > 0")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("group")) - 1
    return grouped.select("doc_id", number.alias("section_no"), F.coalesce("heading", F.lit("Abstract")).alias("heading"), "text", "formulas", "tables")


def flatten_sections(sections: DataFrame) -> DataFrame:
    """(doc_id, text): sections one after another, each under its ## heading."""
    one = F.concat(F.lit("\n\n## "), "heading", F.lit("\n\n"), "text")
    parts = F.array_sort(F.collect_list(F.struct("section_no", one.alias("one"))))
    return sections.groupBy("doc_id").agg(strip(F.array_join(F.transform(parts, lambda p: p["one"]), "")).alias("text"))
