"""Tables as sequences of rows keyed by document and place, and the paragraph table that the structure operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as tx
from folio.functions.core import case, first_of, lower, plus, swapped, text_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paragraphs(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, text): a row a line, an empty one for a null or empty text."""
    return documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "text"))


def line_form(t, n, doc):
    """A whole line in one of sixteen forms of Markdown and prose, by its place: nothing of it is cut."""
    k = (doc + n) % 16
    cyrillic = swapped(lower(t), "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстуввхыз")
    return case(
        (k == 0, plus("# ", t)), (k == 1, plus("## ", t)), (k == 2, plus("- ", t)), (k == 3, plus(text_of(n + 1), ". ", t)),
        (k == 4, plus(t, " .....", text_of(n + 5))), (k == 5, plus("> ", t)), (k == 6, plus("— ", t)), (k == 7, plus("Figure ", text_of(n + 1), ". ", t)),
        (k == 8, lower(t)), (k == 9, plus(t, ",")), (k == 10, cyrillic), (k == 11, plus("## ", t, " ", t)),
        (k == 12, plus("**", t, "**")), (k == 13, plus("[", t, "](https://example.org/", text_of(n), ")")), other=t,
    )


def companion(n, doc):
    """A short row after each line: furniture, headings, anchors, contents and index rows."""
    k, m = (doc * 3 + n) % 20, text_of(n)
    return case(
        (k == 0, m), (k == 1, "Contents"), (k == 2, plus("[[DOCX_IMAGE_img_", m, "]]")), (k == 3, "This page intentionally left blank"),
        (k == 4, plus("Chapter ", text_of(n + 1))), (k == 5, plus("[", text_of(n % 90), "]")), (k == 6, plus("Alpha ", m, ", Beta ", text_of(n + 1), "; Gamma ", text_of(n + 2), ", Delta ", text_of(n + 3))), (k == 7, "---"),
        (k == 8, "The Common Header"), (k == 9, "and so it goes on"), (k == 10, plus("Введение .....", text_of(n + 3))), (k == 11, "NOTES"),
        (k == 12, plus("* item ", m)), (k == 13, "Part One"), (k == 14, plus("Table ", m, ": sizes")), (k == 15, "https://example.org/page"),
        (k == 16, ""), (k == 17, "He said that"), (k == 18, plus("(", text_of(n % 90), ") A footnote body")), other="Confidential",
    )


def marked(rows: DataFrame) -> DataFrame:
    """Two rows a line: the whole line in one of the forms, and its companion; (doc_id, pos, text)."""
    n, doc = F.col("pos"), F.col("doc_id")
    both = F.array(F.struct((n * 2).alias("pos"), line_form(F.col("text"), n, doc).alias("text")), F.struct((n * 2 + 1).alias("pos"), companion(n, doc).alias("text")))
    return rows.select("doc_id", F.inline(both))


def attributes(text, pos, doc):
    """Columns of a paragraph beside its text, by its place and its text: name and value, each from those before it."""
    h = doc * 31 + pos * 7
    style = case((h % 29 == 0, "Heading 2"), (h % 29 == 1, "Caption"), (h % 29 == 2, "List Bullet"), (h % 29 == 3, "Title"), (h % 5 == 0, "Body Text"), (h % 5 == 1, ""), other="Normal")
    return {
        "paragraph_id": plus("p", text_of(pos)),
        "style_name": style,
        "alignment": case((h % 31 == 0, "center"), (h % 31 == 1, "right"), (h % 3 == 0, "both")),
        "font_size": case((h % 37 == 0, 18.0), (h % 37 == 1, 14.0), (h % 37 == 2, 8.0), (h % 37 == 3, 24.5), (h % 37 != 4, 11.0)),
        "is_bold": h % 41 == 0,
        "page": pos - pos % 20,
        "layout_origin": case((h % 43 == 0, "textbox"), other="paragraph"),
        "list_kind": tx.list_kind(text),
    }


def roles(text, style, alignment):
    """heading_level, role and structural_role, from text and style."""
    level = first_of(tx.style_level(style), tx.heading_level(text))
    role = tx.paragraph_role(text, style, level)
    structural = case(
        (lower(tx.strip(text)).isin("contents", "table of contents", "содержание"), "toc_header"),
        (tx.is_toc_entry(text), "toc_entry"),
        ((role == "body") & tx.is_attribution(text), "attribution"),
        ((role == "body") & (alignment == "center"), "epigraph"),
        other="body",
    )
    return level, role, structural


def paragraph_table(rows: DataFrame) -> DataFrame:
    """The paragraph table: rows of marked() with style, alignment, font, page, list kind, heading level, role and structural role."""
    with_attributes = rows.select("doc_id", "pos", "text", *[v.alias(k) for k, v in attributes(F.col("text"), F.col("pos"), F.col("doc_id")).items()])
    level, role, structural = roles(F.col("text"), F.col("style_name"), F.col("alignment"))
    return with_attributes.select("*", level.cast("int").alias("heading_level"), role.alias("role"), structural.alias("structural_role")).withColumn("asset_id", F.when(F.col("role") == "image", F.col("text")))


def blocks(rows: DataFrame) -> DataFrame:
    """Cleanup blocks: id, index, hash, counts, kind and flags of each row."""
    t = F.col("text")
    out = rows.select(
        "doc_id", "pos", F.format_string("b_%06d", F.col("pos")).alias("block_id"), tx.short_hash(tx.strip(t)).alias("text_hash"),
        F.length(t).alias("char_count"), F.length(F.regexp_replace(t, r"\s", "")).alias("solid_count"), tx.block_kind(t).alias("kind"),
    )
    return out.withColumns({"is_heading": F.col("kind") == "heading", "is_toc_like": F.col("kind") == "toc_like"})
