"""Blocks of a document as jobs: units that stay together, blocks by a budget of characters, what is read around each, segments."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import fixed as fx
from folio.functions import text as tx
from folio.operators.sequences import by_place, ordered_pass

FALLBACK_CHARS = 24_000


def rendered_rows(paragraphs: DataFrame) -> DataFrame:
    c = F.col
    return paragraphs.withColumn("rendered", tx.rendered(c("text"), c("role"), c("structural_role"), c("heading_level"), c("list_kind"), F.lit(0)))


def units(paragraphs: DataFrame, found: DataFrame) -> DataFrame:
    """The paragraph table with `unit`: members of an accepted relation, neighbouring quotes and neighbouring contents rows stay together.

    All of these are runs of neighbours, so a unit ends where no tie leads to the next row: a running sum, no graph.
    """
    spans = found.where("decision = 'accept'").select("doc_id", F.explode(F.sequence(F.col("first_pos") + 1, F.col("first_pos") + F.col("n_members").cast("int") - 1)).alias("pos")).distinct()
    tied = paragraphs.join(spans.withColumn("related", F.lit(True)), ["doc_id", "pos"], "left")
    kind, before = F.col("structural_role"), F.lag("structural_role").over(by_place())
    alike = (kind.isin(*fx.QUOTE_ROLES) & before.isin(*fx.QUOTE_ROLES)) | (kind.isin(*fx.TOC_ROLES) & before.isin(*fx.TOC_ROLES))
    return tied.withColumn("unit", F.sum(F.when(F.col("related").isNotNull() | F.coalesce(alike, F.lit(False)), 0).otherwise(1)).over(by_place())).drop("related")


def unit_rows(paragraphs: DataFrame, found: DataFrame) -> DataFrame:
    """One row a unit, pos its first place: its size as text and what all its members are."""
    c = F.col
    rows = rendered_rows(units(paragraphs, found))
    every = lambda test: F.min(F.when(test, 1).otherwise(0)) == 1
    return rows.groupBy("doc_id", "unit").agg(
        F.min("pos").alias("pos"), F.count("pos").alias("n"), (F.sum(F.length("rendered")) + 2 * (F.count("pos") - 1)).alias("size"), F.max(c("role").isin("image", "table").cast("int")).alias("atomic"),
        every(c("role") == "heading").alias("headings"), every(c("role") == "list").alias("lists"), every(c("role") == "caption").alias("captions"), every(c("structural_role").isin(*fx.QUOTE_ROLES)).alias("quotes"),
        every(c("structural_role").isin(*fx.TOC_ROLES)).alias("toc"), F.max_by("role", "pos").alias("last_role"),
    )


def packing(max_chars: int):
    """The fold over units: (block, size, paragraphs, atomic, all headings, all lists, all contents, last role)."""
    soft = max(1200, min(max_chars, int(max_chars * 0.7)))

    def step(state, size, n, atomic, headings, lists, captions, quotes, toc, last_role):
        if state is None:
            return 0, (0, size, n, atomic, headings, lists, toc, last_role)
        block, held, count, had_atomic, had_headings, had_lists, had_toc, last = state
        grown = held + 2 + size
        if had_atomic or atomic or toc != had_toc:
            fits = False
        elif headings or had_headings:
            fits = had_headings
        elif last == "heading" and (quotes or captions):
            fits = True
        elif had_lists and lists:
            fits = grown <= max_chars or held < soft
        elif had_lists and (held >= max(600, soft // 2) or count > 1):
            fits = False
        else:
            fits = grown <= max_chars and (held < soft or (size <= max(500, max_chars // 4) and held < int(max_chars * 0.9)))
        if fits:
            return block, (block, grown, count + n, had_atomic or atomic, had_headings and headings, had_lists and lists, had_toc and toc, last_role)
        return block + 1, (block + 1, size, n, atomic, headings, lists, toc, last_role)

    return step


def semantic_blocks(paragraphs: DataFrame, found: DataFrame, max_chars: int = 6000) -> DataFrame:
    """(doc_id, unit, block): units packed in order into blocks of about max_chars, by what they are."""
    read = ["size", "n", "atomic", "headings", "lists", "captions", "quotes", "toc", "last_role"]
    return ordered_pass(unit_rows(paragraphs, found), read, "block", pa.int64(), lambda: None, packing(max_chars)).select("doc_id", "unit", "block")


def block_texts(paragraphs: DataFrame, found: DataFrame, max_chars: int = 6000) -> DataFrame:
    """One row a block: (doc_id, block, first_pos, paragraph_count, toc_count, images, target_text)."""
    c = F.col
    rows = rendered_rows(units(paragraphs, found)).join(semantic_blocks(paragraphs, found, max_chars), ["doc_id", "unit"])
    one = lambda test: F.sum(F.when(test, 1).otherwise(0))
    out = rows.groupBy("doc_id", "block").agg(
        F.min("pos").alias("first_pos"), F.count("pos").alias("paragraph_count"), one(c("structural_role").isin(*fx.TOC_ROLES)).alias("toc_count"), one(c("role") == "image").alias("images"), F.array_sort(F.collect_list(F.struct("pos", "rendered"))).alias("own"),
    )
    return out.withColumn("target_text", F.array_join(F.transform("own", lambda x: x["rendered"]), "\n\n")).drop("own")


def _budgets(max_chars: int) -> tuple[int, int]:
    return max(600, min(1400, int(max_chars * 0.2))), max(300, min(800, int(max_chars * 0.12)))


def context_sizes(blocks: DataFrame, text: str, limit: int, reverse: bool) -> Column:
    """How many characters of the neighbouring blocks' texts are read beside each block: whole blocks with two characters between, the last one cut."""
    own = F.length(tx.strip(F.col(text)))
    window = Window.partitionBy("doc_id").orderBy(F.col("block").asc() if not reverse else F.col("block").desc()).rowsBetween(1, Window.unboundedFollowing)
    total = F.sum(F.when(own > 0, own + 2)).over(window)
    return F.greatest(F.least(F.coalesce(total - 2, F.lit(0)), F.lit(limit)), F.lit(0))


def editing_jobs(paragraphs: DataFrame, found: DataFrame, max_chars: int = 6000, operation: str = "edit") -> DataFrame:
    """One job a block: (doc_id, block, job_kind, paragraph_count, toc_count, toc_dominant, target_chars, before_chars, after_chars)."""
    c = F.col
    before, after = _budgets(max_chars)
    blocks = block_texts(paragraphs, found, max_chars)
    all_images = c("images") == c("paragraph_count")
    all_toc = c("toc_count") == c("paragraph_count")
    narrated = ~all_toc & ~all_images
    passing = all_images | (F.lit(operation == "audiobook") & ~narrated) | (F.lit(operation != "translate") & all_toc)
    return blocks.select(
        "doc_id", "block", F.when(passing, "passthrough").otherwise("llm").alias("job_kind"), "paragraph_count", "toc_count", (c("toc_count") * 10 >= c("paragraph_count") * 7).alias("toc_dominant"), F.length("target_text").alias("target_chars"),
        context_sizes(blocks, "target_text", before, True).alias("before_chars"), context_sizes(blocks, "target_text", after, False).alias("after_chars"),
    )


def segments(paragraphs: DataFrame, chunk_size: int = 6000) -> DataFrame:
    """Segments that headings open, what precedes the first one being front matter; one too long is its heading and parts.

    (doc_id, ordinal, first_pos, last_pos, level, role, confidence, paragraphs, chars, words, tokens)
    """
    c, most = F.col, max(4 * chunk_size, FALLBACK_CHARS)
    heading = (c("role") == "heading") & ~c("structural_role").isin("toc_header", "toc_entry", "caption", "image", "table") & (tx.strip(c("text")) != "")
    rows = paragraphs.select("doc_id", "pos", "text", "heading_level", heading.alias("starts"), F.length("text").alias("n"), F.size(tx.words(c("text"))).alias("n_words"))
    rows = rows.withColumn("head", F.sum(F.when(c("starts"), 1).otherwise(0)).over(by_place()))
    group = Window.partitionBy("doc_id", "head")
    rows = rows.withColumn("total", F.sum("n").over(group)).withColumn("long", (c("total") > most) & (F.count("pos").over(group) > 1))

    def step(state, head, starts, long, n):
        last, part, size = state
        if head != last:
            return 0, (head, 0, n if not (long and starts) else -1)
        if long and (size < 0 or size >= most):
            return part + 1, (head, part + 1, n)
        return part, (head, part, size + n)

    cut = ordered_pass(rows, ["head", "starts", "long", "n"], "part", pa.int64(), lambda: (None, 0, 0), step)
    level = F.coalesce(c("heading_level"), tx.likely_level(c("text")))
    own = cut.groupBy("doc_id", "head", "part").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min_by(level, "pos").alias("own_level"), F.min_by("text", "pos").alias("title"), F.max("long").alias("long"), F.count("pos").alias("paragraphs"), F.sum("n").alias("chars"), F.sum("n_words").alias("words"),
    )
    top = F.first("own_level").over(Window.partitionBy("doc_id", "head").orderBy("part"))
    title = F.first("title").over(Window.partitionBy("doc_id", "head").orderBy("part"))
    made = own.withColumns({"level": F.when(c("head") == 0, 1).when(c("part") > 0, F.least(top + 1, F.lit(6))).otherwise(top), "opening": title})
    role = F.when(c("head") == 0, F.when(c("long"), "body_range").otherwise("front_matter")).otherwise(tx.heading_role(c("opening"), c("level") - F.when(c("part") > 0, 1).otherwise(0)))
    confidence = F.when((c("part") > 0) | ((c("head") == 0) & c("long")), "low").when(c("head") == 0, "medium").otherwise("high")
    ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy("first_pos"))
    return made.select("doc_id", ordinal.alias("ordinal"), "first_pos", "last_pos", "level", role.alias("role"), confidence.alias("confidence"), "paragraphs", "chars", "words", F.greatest(F.lit(1), F.floor(c("chars") / 4)).alias("tokens"))


def parents(found: DataFrame, levels: int = 6) -> DataFrame:
    """(doc_id, ordinal, parent): the nearest segment before it of a smaller level."""
    c = F.col
    before = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    nearest = [F.when(c("level") > k, F.max(F.when(c("level") <= k, c("ordinal"))).over(before)) for k in range(1, levels)]
    # The nearest of a smaller level: that of the largest bound below its own.
    chosen = F.coalesce(*[F.when(c("level") == k + 1, n) for k, n in enumerate(nearest, 1)], F.lit(None).cast("int"))
    return found.select("doc_id", "ordinal", chosen.alias("parent"))


def segment_ids(found: DataFrame, version: str = "chapter_segments_v1") -> DataFrame:
    """(doc_id, ordinal, segment_id): number and a hash of what defines the segment."""
    payload = F.concat_ws("|", *[F.col(x).cast("string") for x in ("doc_id", "role", "level", "first_pos", "last_pos")], F.lit(version))
    return found.select("doc_id", "ordinal", F.concat(F.format_string("seg_%04d_", F.col("ordinal")), F.substring(F.sha1(payload.cast("binary")), 1, 8)).alias("segment_id"))


def segment_of_blocks(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks that lie whole within one segment: (doc_id, block, ordinal); null where a block spans several."""
    spans = blocks.select("doc_id", "block", "first_pos", (F.col("first_pos") + F.col("paragraph_count") - 1).alias("end_pos"))
    own = found.select("doc_id", "ordinal", F.col("first_pos").alias("low"), F.col("last_pos").alias("high"))
    met = spans.join(own, "doc_id").where("first_pos >= low AND end_pos <= high").select("doc_id", "block", "ordinal")
    return spans.select("doc_id", "block").join(met, ["doc_id", "block"], "left")
