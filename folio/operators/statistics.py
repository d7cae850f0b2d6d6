"""Small statistics over groups: thresholds, nearest-rank quantiles, modes, spans of a page's text layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import layout
from folio.functions import text as tx
from folio.functions.core import reasons


def otsu(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, threshold): the value that parts a group's values with the greatest variance between, midway between its neighbours; the largest of fewer than three.

    Equal values are one row with a count, so the running sums go over distinct values.
    """
    c = F.col
    counted = rows.where(c(value).isNotNull()).groupBy(group, c(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    order, whole = Window.partitionBy(group).orderBy("v"), Window.partitionBy(group)
    low = counted.withColumns({"left_n": F.sum("n").over(order), "left_sum": F.sum(c("v") * c("n")).over(order), "all_n": F.sum("n").over(whole), "all_sum": F.sum(c("v") * c("n")).over(whole), "next_v": F.lead("v").over(order), "top": F.max("v").over(whole)})
    right_n = c("all_n") - c("left_n")
    between = F.when(right_n > 0, c("left_n") * right_n * F.pow(c("left_sum") / c("left_n") - (c("all_sum") - c("left_sum")) / F.when(right_n > 0, right_n), 2))
    best = low.withColumn("between", F.round(between, 6)).groupBy(group).agg(F.max("all_n").alias("n"), F.max("top").alias("top"), F.max(F.when(c("between").isNotNull(), F.struct("between", (-c("v")).alias("v"), "next_v"))).alias("b"))
    return best.select(group, F.when(c("n") < 3, c("top")).otherwise(F.coalesce((-c("b.v") + c("b.next_v")) / 2, c("top"))).alias("threshold"))


def ranked(values: Column, share: float) -> Column:
    """The value at index round(share * (n - 1)) of a sorted array, half to even."""
    return F.get(values, F.greatest(F.least(F.bround(share * (F.size(values) - 1)).cast("int"), F.size(values) - 1), F.lit(0)))


def nearest_rank(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, n, and a column a share). A group's values are sorted in one array: for groups of bounded size."""
    own = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("v"))
    return own.select(group, F.size("v").alias("n"), *[F.round(ranked(F.col("v"), s), 4).alias(name) for name, s in shares.items()])


def mode_of_halves(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, mode): the most frequent half of a unit, the least on a tie."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(group, (F.bround(F.col(value).cast("double") * 2) / 2).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(group).agg(F.max(F.struct("n", (-F.col("v")).alias("less"))).alias("m")).select(group, (-F.col("m.less")).alias("mode"))


def zones(spans: DataFrame) -> DataFrame:
    """spans (doc_id, page, text, top, bottom, page_height, ...) with `zone`: top, bottom or body."""
    c = F.col
    known = c("page_height") > 0
    upper = F.when(known, F.greatest(F.lit(80.0), c("page_height") * 0.1)).otherwise(80.0)
    lower = F.when(known, c("page_height") - upper).otherwise(720.0)
    return spans.withColumn("zone", F.when((c("top") <= upper) | (c("bottom") <= upper), "top").when((c("top") >= lower) | (c("bottom") >= lower), "bottom").otherwise("body"))


def page_furniture_keys(spans: DataFrame) -> DataFrame:
    """(doc_id, zone, key, pages): texts at the edges of three pages or of all, of two pages at least."""
    c = F.col
    rows = zones(spans).withColumn("key", F.lower(tx.squeeze(c("text")))).where("key <> ''")
    pages = rows.groupBy("doc_id").agg(F.countDistinct("page").alias("n_pages"))
    found = rows.where("zone <> 'body'").groupBy("doc_id", "zone", "key").agg(F.countDistinct("page").alias("pages")).join(pages, "doc_id")
    return found.where((c("n_pages") >= 2) & (c("pages") >= F.least(F.lit(3), c("n_pages")))).select("doc_id", "zone", "key", "pages")


def text_layer_report(spans: DataFrame) -> DataFrame:
    """What a text layer holds and whether it can be used: one row a document."""
    c = F.col
    rows = zones(spans).withColumn("key", F.lower(tx.squeeze(c("text")))).where("key <> ''")
    met = rows.join(page_furniture_keys(spans).select("doc_id", "zone", "key", F.lit(True).alias("furniture")), ["doc_id", "zone", "key"], "left")
    number = tx.full(tx.squeeze(c("text")), r"\d{1,4}|[ivxlcdmIVXLCDM]{1,12}") & (c("zone") != "body")
    met = met.withColumns({"furniture": F.coalesce("furniture", F.lit(False)), "number": number, "chars": F.length(F.regexp_replace(tx.squeeze(c("text")), r"\s+", ""))})
    sized = met.where(~c("furniture") & ~c("number") & (c("font_size") > 0)).groupBy("doc_id").agg(F.median("font_size").alias("median_size"), F.max("font_size").alias("largest_size"))
    met = met.join(sized, "doc_id", "left")
    words, letters, caps = F.size(tx.words(c("text"))), tx.matches(c("text"), r"\p{L}"), tx.matches(c("text"), r"\p{Lu}")
    heading = ~c("number") & (words <= 14) & (F.coalesce(c("font_size") >= c("median_size") * 1.18, F.lit(False)) | (c("is_bold") & ((letters > 0) & (caps * 100 >= letters * 55) | (words <= 8))))
    body = ~c("furniture") & ~c("number")
    one, chars = lambda t: F.sum(F.when(t, 1).otherwise(0)), lambda t: F.sum(F.when(t, c("chars")).otherwise(0))
    out = met.groupBy("doc_id").agg(
        F.countDistinct("page").alias("pages"), F.count("key").alias("spans"), F.sum("chars").alias("visible"), chars(body).alias("body_chars"), chars(c("furniture")).alias("furniture_chars"), one(body).alias("body_spans"), one(heading).alias("headings"),
        one(tx.like(tx.squeeze(c("text")), r"^(?:[-*•●]|\d+[.)])\s+")).alias("lists"), one(c("is_bold")).alias("bold"), F.max("median_size").alias("median_size"), F.max("largest_size").alias("largest_size"),
    )
    out = out.withColumns({"body_ratio": tx.ratio(c("body_chars"), c("visible")), "furniture_ratio": tx.ratio(c("furniture_chars"), c("visible")), "structured": (c("headings") > 0) | (c("lists") > 0) | (c("bold") > 0) | F.coalesce(c("largest_size") > c("median_size"), F.lit(False))})
    against = reasons(*layout.text_layer_reasons(c))
    out = out.withColumn("reasons", F.when((c("visible") == 0) | (c("body_spans") == 0), "empty_text_layer").when((c("visible") < 500) | (c("body_spans") < 10), "too_little_text_layer").otherwise(against))
    decision = F.when(c("reasons").isin("empty_text_layer", "too_little_text_layer"), "scanned_or_unsupported").when(c("reasons") == "", "promising").otherwise("insufficient")
    return out.select("doc_id", "pages", "spans", "visible", "body_chars", "body_ratio", "furniture_ratio", "body_spans", "headings", "lists", "bold", decision.alias("decision"), "reasons")


def hyphen_evidence(rows: DataFrame, text: str) -> DataFrame:
    """(doc_id, word): words seen whole whose hyphenated form is never seen, which is when a soft wrap drops its hyphen."""
    words = rows.select("doc_id", F.explode(tx.found(F.lower(F.col(text)), r"\p{L}+(?:-\p{L}+)*")).alias("word")).distinct()
    hyphenated = words.where(F.contains("word", F.lit("-"))).select("doc_id", F.replace("word", F.lit("-"), F.lit("")).alias("word")).distinct()
    return words.where(~F.contains("word", F.lit("-"))).join(hyphenated, ["doc_id", "word"], "left_anti")
