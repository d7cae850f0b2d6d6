"""Structure of a document from its paragraph table: layout cleanup, font tiers, reports, relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import fixed as fx
from folio.functions import layout
from folio.functions import text as tx
from folio.operators.sequences import by_place, runs, toc_regions

#: Rows at a document's start whose headings are titles.
TITLE_ROWS = 12


def by_key():
    return Window.partitionBy("doc_id", "key")


def _keyed(paragraphs: DataFrame) -> DataFrame:
    """The paragraph table with layout keys, title flags and the counts of repeats. One shuffle by document serves every window here."""
    c = F.col
    rows = paragraphs.repartition("doc_id").withColumn("key", tx.layout_key(c("text")))
    title = (c("pos") < TITLE_ROWS) & (c("key") != "") & ((c("role") == "heading") | c("heading_level").isNotNull())
    rows = rows.withColumn("is_title", F.max(F.when(title, 1).otherwise(0)).over(by_key()) == 1)
    rows = rows.withColumn("is_candidate", layout.repeat_candidate(c("text"), c("key"), c("role"), c("structural_role"), c("list_kind"), c("is_title")))
    rows = rows.withColumn("is_cadence", layout.cadence_candidate(c("text"), c("key"), c("role"), c("list_kind")))
    return rows.withColumn("repeats", F.greatest(F.sum(F.when(c("is_candidate"), 1).otherwise(0)).over(by_key()), F.lit(1)))


def page_furniture(paragraphs: DataFrame) -> DataFrame:
    """Keys that repeat at the pace of pages: (doc_id, key, n, first_pos, last_pos). For documents scanned from pages only."""
    rows = _keyed(paragraphs)
    sizes = rows.groupBy("doc_id").agg(F.count("pos").alias("n_rows"))
    found = rows.where("is_cadence").groupBy("doc_id", "key").agg(F.count("pos").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")).join(sizes, "doc_id")
    return found.where(layout.page_cadence(F.col("n"), F.col("n_rows"), F.col("first_pos"), F.col("last_pos"))).drop("n_rows")


def layout_cleanup(paragraphs: DataFrame, min_repeat: int = 3, remove: bool = False, scanned: bool = False) -> DataFrame:
    """What becomes of each paragraph: (doc_id, pos, action, reason, confidence, repeats)."""
    c, least = F.col, max(2, min_repeat)
    rows = _keyed(paragraphs).withColumn("is_furniture", F.lit(False))
    if scanned:
        pick = lambda f, x: f(F.when(c("is_cadence"), x)).over(by_key())
        n_rows = F.count("pos").over(Window.partitionBy("doc_id"))
        rows = rows.withColumn("is_furniture", c("is_cadence") & layout.page_cadence(pick(F.count, c("pos")), n_rows, pick(F.min, c("pos")), pick(F.max, c("pos")), max(least, 6)))
    reason = layout.cleanup_reason(c("text"), c("key"), c("role"), c("structural_role"), c("list_kind"), c("layout_origin"), c("repeats"), c("is_title"), c("is_furniture"), c("is_candidate"), least)
    rows = rows.withColumn("reason", reason).withColumn("action", layout.cleanup_action(c("reason"), remove))
    return rows.select("doc_id", "pos", "action", "reason", layout.cleanup_confidence(c("reason"), c("action")).alias("confidence"), "repeats")


def cleanup_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("action", "reason").agg(F.count("pos").alias("n"))


def layout_tiers(paragraphs: DataFrame, heading_ratio: float = 1.15, tolerance: float = 0.25, population: int = 2, short: int = 80) -> DataFrame:
    """Font tiers: (doc_id, pos, tier, is_heading_tier, first_on_page, is_short).

    The baseline is the most frequent size of a document, the least on a tie, of eight sizes or more; tier 0 is near it,
    1 and on are larger sizes, the largest first, of `population` rows or the largest of all; -1 is none.
    """
    c = F.col
    size = F.when(c("font_size") > 0, F.round("font_size", 1))
    rows = paragraphs.withColumn("size", size)
    counted = rows.where(~c("role").isin("image", "table") & c("size").isNotNull()).groupBy("doc_id", "size").agg(F.count("pos").alias("n"))
    base = counted.groupBy("doc_id").agg(F.sum("n").alias("total"), F.max(F.struct("n", (-c("size")).alias("less"))).alias("most")).where("total >= 8").select("doc_id", (-c("most.less")).alias("base"))
    above = rows.join(base, "doc_id").where(c("font_size") > c("base") + tolerance).groupBy("doc_id", "size").agg(F.count("pos").alias("n"))
    order = Window.partitionBy("doc_id").orderBy(c("size").desc())
    tiers = above.withColumn("rank", F.row_number().over(order)).where((c("n") >= population) | (c("rank") == 1)).withColumn("above_tier", F.row_number().over(order)).select("doc_id", "size", "above_tier")
    met = rows.join(base, "doc_id", "left").join(tiers, ["doc_id", "size"], "left")
    tier = F.when(c("base").isNull() | c("size").isNull(), -1).when(F.abs(c("font_size") - c("base")) <= tolerance, 0).when(c("font_size") > c("base") + tolerance, F.coalesce("above_tier", F.lit(-1))).otherwise(-1)
    page = F.lag("page").over(by_place())
    return met.withColumn("tier", tier).select(
        "doc_id", "pos", "tier", F.coalesce((c("tier") > 0) & (c("size") >= c("base") * heading_ratio), F.lit(False)).alias("is_heading_tier"),
        F.coalesce(page != c("page"), F.lit(False)).alias("first_on_page"), (F.length(tx.strip(c("text"))) <= short).alias("is_short"),
    )


def style_clusters(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, pos, cluster): null for the most common style (the first seen on a tie) and for none; the others are numbered as they appear."""
    rows = paragraphs.select("doc_id", "pos", F.lower(tx.strip(F.col("style_name"))).alias("style"))
    seen = rows.where("style <> ''").groupBy("doc_id", "style").agg(F.count("pos").alias("n"), F.min("pos").alias("at"))
    usual = Window.partitionBy("doc_id").orderBy(F.desc("n"), "at")
    others = seen.withColumn("rank", F.row_number().over(usual)).where("rank > 1")
    numbered = others.select("doc_id", "style", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")).alias("cluster"))
    return rows.join(numbered, ["doc_id", "style"], "left").select("doc_id", "pos", "cluster")


def structure_report(paragraphs: DataFrame) -> DataFrame:
    """A document's structure in numbers, what speaks against it, its risk and whether it is ready."""
    c = F.col
    names = ("text", "role", "structural_role", "alignment", "list_kind")
    flags = layout.risk_flags(*[c(n) for n in names])
    rows = paragraphs.select("doc_id", "pos", "structural_role", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in flags.items()])
    total = lambda *x: F.sum(F.when(F.expr(" OR ".join(x)), 1).otherwise(0))
    counts = rows.groupBy("doc_id").agg(
        F.count("pos").alias("n_rows"), *[total(k).alias(v) for k, v in {"filled": "filled", "heading": "headings", "short_body": "short_body", "isolated": "isolated", "toc_entry": "toc_entries"}.items()],
        total("all_caps", "centered").alias("caps_or_centered"), F.coalesce(F.min(F.when(~c("front"), c("pos"))), F.count("pos")).alias("front_run"),
    )
    sequences = runs(rows, c("toc_candidate")).where("key AND length >= 4").groupBy("doc_id").agg(F.count("length").alias("toc_sequences"))
    bodies = runs(rows, c("body_text")).where("key").groupBy("doc_id").agg(F.max("length").alias("longest_body"))
    regions = toc_regions(rows).groupBy("doc_id").agg(F.count("first_pos").alias("toc_regions"))
    for more in (sequences, bodies, regions):
        counts = counts.join(more, "doc_id", "left")
    counts = counts.na.fill(0, ["toc_sequences", "longest_body", "toc_regions"])
    found = tx.reasons(*layout.escalation(c))
    out = counts.withColumn("reasons", found).withColumn("risk", layout.risk_level(c("reasons")))
    return out.withColumn("readiness", layout.readiness(c, c("risk")))


def _toc_groups(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, first_pos, n, headed): each header with the entries right behind it, and each run of entries without one."""
    c = F.col
    role = c("structural_role")
    rows = paragraphs.where(role.isin(*fx.TOC_ROLES)).select("doc_id", "pos", "structural_role")
    breaks = F.when((F.lag("pos").over(by_place()) == c("pos") - 1) & (role == "toc_entry"), 0).otherwise(1)
    grouped = rows.withColumn("group", F.sum(breaks).over(by_place())).groupBy("doc_id", "group")
    return grouped.agg(F.min("pos").alias("first_pos"), F.count("pos").alias("n"), F.max((role == "toc_header").cast("int")).alias("headed"))


def relations(paragraphs: DataFrame) -> DataFrame:
    """Captions with their assets, epigraphs with who said them, contents: (doc_id, kind, decision, reason, first_pos, n_members, relation_id).

    Accepted ones are numbered within a document: captions first, then epigraphs, then contents, each by place.
    """
    c = F.col
    lag, lead = lambda x: F.lag(x).over(by_place()), lambda x: F.lead(x).over(by_place())
    rows = paragraphs.withColumns({"before": lag("role"), "before_asset": lag("asset_id"), "next_role": lead("role"), "next_kind": lead("structural_role"), "next_text": lead("text")})
    asset = F.coalesce(c("before").isin("image", "table"), F.lit(False))
    captions = rows.where((c("role") == "caption") | (asset & (c("role") != "heading") & tx.is_caption(c("text"))))
    refused = F.when(c("before").isNull(), "caption_without_preceding_asset").when(~asset, "caption_not_adjacent_to_asset").when(c("before_asset").isNull(), "missing_caption_anchor_identity")
    captions = captions.select(
        "doc_id", F.when(asset, F.concat("before", F.lit("_caption"))).otherwise("caption_attachment").alias("kind"), F.when(refused.isNull(), "accept").otherwise("reject").alias("decision"),
        F.coalesce(refused, F.lit("adjacent_asset_caption")).alias("reason"), F.when(refused.isNull() | asset, c("pos") - 1).otherwise(c("pos")).alias("first_pos"), F.when(refused.isNull() | asset, 2).otherwise(1).alias("n_members"), F.lit(1).alias("pass"),
    )
    plain = ~c("role").isin("image", "table", "caption", "list") & ~c("next_role").isin("image", "table", "caption", "list")
    epigraph, said = c("structural_role") == "epigraph", c("next_kind") == "attribution"
    centred = F.coalesce(c("alignment") == "center", F.lit(False))
    pair = plain & ((epigraph & said) | (epigraph & tx.is_attribution(c("next_text"))) | (said & centred))
    why = F.when(epigraph & ~said, "epigraph_without_attribution").when(said & ~epigraph, "attribution_without_epigraph").when(epigraph & tx.is_attribution(c("next_text")), "epigraph_candidate_rejected")
    quotes = rows.where(c("next_role").isNotNull() & (pair | why.isNotNull())).select(
        "doc_id", F.lit("epigraph_attribution").alias("kind"), F.when(pair, "accept").otherwise("reject").alias("decision"), F.when(pair, "adjacent_epigraph_attribution").otherwise(why).alias("reason"), c("pos").alias("first_pos"), F.lit(2).alias("n_members"), F.lit(2).alias("pass"),
    )
    headed = c("headed") == 1
    contents = _toc_groups(paragraphs).select(
        "doc_id", F.lit("toc_region").alias("kind"), F.when(c("n") >= 2, "accept").otherwise("reject").alias("decision"),
        F.when((c("n") >= 2) & headed, "toc_header_with_entries").when(c("n") >= 2, "contiguous_toc_entries").when(headed, "toc_header_without_entries").otherwise("isolated_toc_entry").alias("reason"), "first_pos", c("n").alias("n_members"), F.lit(3).alias("pass"),
    )
    every = captions.unionByName(quotes).unionByName(contents)
    nth = F.sum(F.when(c("decision") == "accept", 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("pass", "first_pos"))
    return every.withColumn("relation_id", F.when(c("decision") == "accept", F.format_string("rel_%04d", nth))).drop("pass")


def attached_assets(paragraphs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, pos, attached_to): captions with the asset that an accepted relation gives them, null for the others."""
    links = found.where("decision = 'accept' AND kind IN ('image_caption', 'table_caption')").select("doc_id", (F.col("first_pos") + 1).alias("pos"), F.col("first_pos").alias("asset_pos"))
    assets = paragraphs.select("doc_id", F.col("pos").alias("asset_pos"), F.col("asset_id").alias("attached_to"))
    return paragraphs.where("role = 'caption'").select("doc_id", "pos").join(links, ["doc_id", "pos"], "left").join(assets, ["doc_id", "asset_pos"], "left").select("doc_id", "pos", "attached_to")
