"""Detectors over the ordered lines of a document: what they find, with place and reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import fixed as fx
from folio.functions import text as tx
from folio.operators.sequences import by_place


def outside_fences(rows: DataFrame) -> DataFrame:
    """Lines that are in no fenced code and are no fences: the parity of the fences so far."""
    fence = F.when(tx.like(F.col("text"), r"^\s*(?:`{3,}|~{3,})"), 1).otherwise(0)
    marked = rows.withColumn("fence", fence).withColumn("fences", F.sum("fence").over(by_place()))
    return marked.where("fence = 0 AND fences % 2 = 0").drop("fence", "fences")


def mixed_script_words(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, token): each word that mixes Latin and Cyrillic letters, once a line; not in addresses."""
    w = F.explode(tx.words(F.regexp_replace("text", "`[^`]+`", " "))).alias("word")
    words = outside_fences(rows).select("doc_id", "pos", w).where(~tx.like(F.col("word"), r"://|www\.|@|[\p{L}\p{N}_-]+\.[\p{L}\p{N}_-]{2,}"))
    runs = words.select("doc_id", "pos", F.explode(tx.found(F.col("word"), "[A-Za-zА-Яа-яЁё]+")).alias("token"))
    return runs.where(tx.like(F.col("token"), "[A-Za-z]") & tx.like(F.col("token"), "[А-Яа-яЁё]")).dropDuplicates(["doc_id", "pos", "token"])


def list_fragments(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, reason): list items that go on in the next line, or end in a number that begins the next."""
    c = F.col
    t, after = tx.strip(c("text")), tx.strip(F.coalesce(F.lead("text").over(by_place()), F.lit("")))
    rows = rows.withColumn("t", t).withColumn("after", after).where("t <> ''")
    item, next_item = F.startswith("t", F.lit("- ")), F.startswith("after", F.lit("- "))
    rest = tx.strip(F.substr("after", F.lit(3)))
    lower, n = tx.like(rest, "^[a-zа-яё]"), F.size(tx.words(rest))
    number = tx.like(c("t"), r"(?:^|\s)\d+\.\z")
    plain = ~tx.starts(c("t"), "- ", "#", ">")
    reason = (
        F.when(item & number, "dangling_number")
        .when(item & next_item & (rest != "") & (lower | (n <= 3)), "item_goes_on")
        .when(plain & next_item & (rest != "") & ~tx.like(c("t"), r"[.!?…:](?:[)\]»”’\x27\x22])?\z") & (lower | (n <= 4)), "prose_goes_on_as_item")
        .when(plain & number, "dangling_number_in_prose")
    )
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select("doc_id", "pos", "reason")


def repeated_headers(rows: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, header, n): what stands left or right of the first page number of a line, in `least` lines of a document or more."""
    number = r"(?:^|[^\p{L}\p{N}_:])((?:page\s+)?(?:\d{1,4}|[ivxlcdm]{1,8}))(?:[^\p{L}\p{N}_:]|\z)"
    c = F.col
    lines = outside_fences(rows).where((tx.strip(c("text")) != "") & ~tx.starts(tx.strip(c("text")), ">") & ~tx.like(tx.strip(c("text")), r"^#{1,6}\s+") & ~tx.like(c("text"), r"\.{2,}\s*\d{1,4}\s*\z"))
    low = lines.select("doc_id", tx.lower(tx.strip(c("text"))).alias("s")).withColumn("token", tx.group(c("s"), number, 1)).where("token <> ''")
    at = F.position(c("token"), c("s"))
    sides = F.explode(F.array(tx.running_header(F.substr(c("s"), F.lit(1), at - 1)), tx.running_header(F.substr(c("s"), at + F.length("token"))))).alias("header")
    return low.select("doc_id", sides).where("header IS NOT NULL").groupBy("doc_id", "header").agg(F.count("header").alias("n")).where(c("n") >= least)


def heading_defects(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, detector): top headings with no body between, headings fused with body, headings that name who said something, blank-page notices."""
    c = F.col
    lines = outside_fences(rows).withColumn("t", tx.strip(c("text"))).where("t <> ''")
    title = tx.group(c("t"), r"^#{1,6}\s+(.*)\z", 1)
    level = tx.heading_level(c("t"))
    lines = lines.withColumns({"title": title, "level": level}).withColumn("next_level", F.lead("level").over(by_place()))
    found = F.explode(
        tx.named(
            ("adjacent_h1_without_body", F.coalesce((c("level") == 1) & (c("next_level") == 1), F.lit(False))),
            ("heading_body_concat_detected", F.coalesce(c("level").isNotNull() & tx.is_heading_body_concat(c("title")), F.lit(False))),
            ("h1_epigraph_attribution_pattern", F.coalesce((c("level") == 1) & tx.is_epigraph_heading(c("title"), None), F.lit(False))),
            ("pdf_blank_page_marker_leakage", c("level").isNull() & ~tx.starts(c("t"), ">") & tx.like(tx.furniture_hits(c("t")), "blank")),
        )
    ).alias("detector")
    return lines.select("doc_id", "pos", found)


def detector_summary(found: DataFrame, most: int = 5) -> DataFrame:
    """(detector, n, and the first places of each): n over all, `most` samples by design."""
    order = Window.partitionBy("detector").orderBy("doc_id", "pos")
    counts = found.groupBy("detector").agg(F.count("pos").alias("n"))
    first = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    return first.join(counts, "detector").select("detector", "n", "nth", "doc_id", "pos")


def context_leaks(rows: DataFrame, words: int = 6) -> DataFrame:
    """(doc_id, pos, leaked): the first run of `words` words of a row that stands in the row before or after it, but not in its own source.

    rows: (doc_id, pos, text, source).
    """
    c = F.col
    key = lambda x: F.concat(F.lit(" "), tx.joined(tx.tokens(x), " "), F.lit(" "))
    own = rows.select("doc_id", "pos", tx.tokens(c("text")).alias("t"), key(c("source")).alias("s")).withColumns({"before": F.lag("s").over(by_place()), "after": F.lead("s").over(by_place())})
    own = own.where(F.size("t") >= words)
    shingles = F.transform(F.sequence(F.lit(1), F.size("t") - words + 1), lambda i: F.concat(F.lit(" "), F.array_join(F.slice(c("t"), i, words), " "), F.lit(" ")))
    hits = F.filter(shingles, lambda x: ~F.contains(c("s"), x) & (F.coalesce(F.contains(c("before"), x), F.lit(False)) | F.coalesce(F.contains(c("after"), x), F.lit(False))))
    return own.select("doc_id", "pos", F.trim(F.get(hits, F.lit(0))).alias("leaked")).where("leaked IS NOT NULL")


def near_duplicates(rows: DataFrame, distance: int = 3, least: int = 24) -> DataFrame:
    """(doc_id, pos, verdict) of blocks of `least` characters or more: whether exactly one block nearby holds their text."""
    c = F.col
    rows = rows.withColumn("t", tx.strip(c("text")))
    beside = [f("t", k).over(by_place()) for k in range(1, distance + 1) for f in (F.lag, F.lead)]
    near = F.array(*beside)
    rows = rows.withColumn("hits", F.size(F.filter(near, lambda x: x.isNotNull() & F.contains(x, c("t")))))
    solid = F.length(F.regexp_replace("t", r"\s+", ""))
    verdict = F.when(solid < least, "duplicate_fragment_too_short").when(c("hits") > 1, "duplicate_fragment_ambiguous_neighbor_match").when(c("hits") == 0, "duplicate_fragment_unique_continuation").otherwise("duplicate")
    return rows.select("doc_id", "pos", verdict.alias("verdict"))


def display_title(paragraphs: DataFrame, rows: int = 12) -> DataFrame:
    """(doc_id, pos): of the first rows the one that looks most like the title: largest font, most letters, longest, first."""
    c = F.col
    t = tx.strip(c("text"))
    letters = tx.matches(t, r"\p{L}")
    fit = (c("pos") < rows) & ~c("role").isin("image", "table", "caption", "list") & ~c("structural_role").isin(*fx.TOC_ROLES) & (F.length(t) <= 180) & (letters >= 8) & (c("font_size") >= 18) & ~tx.like(t, r"[.;!?]\z")
    best = F.max(F.struct(c("font_size").alias("f"), letters.alias("l"), F.length(t).alias("n"), (-c("pos")).alias("p"))).alias("m")
    return paragraphs.where(fit).groupBy("doc_id").agg(best).select("doc_id", (-c("m.p")).alias("pos"))


def adjacent_captions(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, pos, role): rows behind an image or a table that read like its caption become one; explicit headings stay."""
    c = F.col
    behind = F.coalesce(F.lag("role").over(by_place()).isin("image", "table"), F.lit(False))
    return paragraphs.select("doc_id", "pos", F.when(behind & (c("role") != "heading") & tx.is_caption(c("text")), "caption").otherwise(c("role")).alias("role"))


def front_matter_end(paragraphs: DataFrame, long: int = 100, run: int = 3) -> DataFrame:
    """(doc_id, boundary): the first chapter heading with a title, else the first of `run` long body rows in a row; null without either."""
    c = F.col
    s = tx.squeeze(c("text"))
    chapter = F.min(F.when((c("role") == "heading") & tx.like(tx.lower(s), fx.CHAPTER_BODY), c("pos")))
    flag = F.when((c("role") == "body") & (F.length(s) >= long), 1).otherwise(0)
    window = by_place().rowsBetween(0, run - 1)
    rows = paragraphs.withColumn("body_run", F.sum(flag).over(window))
    return rows.groupBy("doc_id").agg(F.coalesce(chapter, F.min(F.when(c("body_run") == run, c("pos")))).alias("boundary"))


def back_matter_start(paragraphs: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(doc_id, start): the first row behind the front matter that is the title of back matter alone."""
    c = F.col
    met = paragraphs.join(boundaries, "doc_id")
    return met.where(tx.lower(tx.squeeze(c("text"))).isin(*fx.BACK_MATTER) & (c("pos") > F.coalesce("boundary", F.lit(-1)))).groupBy("doc_id").agg(F.min("pos").alias("start"))


def passthrough(paragraphs: DataFrame, boundaries: DataFrame, starts: DataFrame) -> DataFrame:
    """(doc_id, pos, category) of every row: by its form, then by where it stands; retained if neither lets it pass."""
    c = F.col
    met = paragraphs.join(boundaries, "doc_id", "left").join(starts, "doc_id", "left")
    back = F.coalesce(c("pos") >= c("start"), F.lit(False))
    category = F.coalesce(
        tx.passthrough_form(c("text"), c("role"), c("structural_role")), F.when(c("pos") < c("boundary"), "front_matter"), F.when(back & tx.is_index_row(c("text")), "index"), F.when(back & ~tx.is_body_prose(c("text")), "references"), F.lit("retained"),
    )
    return met.select("doc_id", "pos", category.alias("category"))


def emphasis(text: Column) -> tuple[Column, Column]:
    """Bold and italic spans of Markdown: threefold marks are both, then twofold, then single ones."""
    triple = r"\*\*\*(?:.+?)\*\*\*"
    a = tx.sub(text, triple, " ")
    b = tx.sub(a, r"\*\*(?:.+?)\*\*", " ")
    three = tx.matches(text, triple)
    return three + tx.matches(a, r"\*\*(?:.+?)\*\*"), three + tx.matches(b, r"\*(?:.+?)\*") + tx.matches(b, r"_(?:.+?)_")
