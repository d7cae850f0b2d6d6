"""Operators over rows ordered within a document: neighbours, runs, chunks, regions.

All partition by doc_id, whose rows are bounded by a document's length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import boundary
from folio.functions import text as tx
from folio.session import ship_package

PARAGRAPH = ("text", "style_name", "alignment", "heading_level", "role", "list_kind")


def by_place():
    """The document's rows in order; a window can only be made once there is a session."""
    return Window.partitionBy("doc_id").orderBy("pos")


def boundary_decisions(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, pos, decision, confidence, reasons, can_lead) for each pair of neighbours, pos of the left row. paragraphs: a paragraph table."""
    own = boundary.edges(*[F.col(c) for c in PARAGRAPH])
    rows = paragraphs.select("doc_id", "pos", F.struct(*[v.alias(k) for k, v in own.items()]).alias("a")).withColumn("b", F.lead("a").over(by_place())).where("b IS NOT NULL")
    made = boundary.decide(lambda n: F.col(f"a.{n}"), lambda n: F.col(f"b.{n}"))
    return rows.select("doc_id", "pos", *[v.alias(k) for k, v in made.items()])


def effective_decisions(paragraphs: DataFrame, mode: str = "high_only") -> DataFrame:
    """(doc_id, pos, decision, confidence, reasons) as a mode takes them: off, high_only or high_and_medium."""
    raw = boundary_decisions(paragraphs)
    if mode == "off":
        return raw.select("doc_id", "pos", F.lit("keep").alias("decision"), "confidence", "reasons")
    if mode == "high_and_medium":
        return raw.drop("can_lead")
    made = boundary.effective(F.col("decision"), F.col("confidence"), F.col("can_lead"), F.col("next_decision"))
    rows = raw.withColumn("next_decision", F.when(F.lead("pos").over(by_place()) == F.col("pos") + 1, F.lead("decision").over(by_place())))
    return rows.select("doc_id", "pos", made["decision"].alias("decision"), "confidence", F.concat_ws(",", F.nullif("reasons", F.lit("")), F.nullif(made["extra"], F.lit(""))).alias("reasons"))


def merge_chains(paragraphs: DataFrame, mode: str = "high_only") -> DataFrame:
    """Paragraphs joined along their merges: (doc_id, first_pos, n_rows, confidence, text); confidence null where nothing was merged."""
    merged = effective_decisions(paragraphs, mode).select("doc_id", (F.col("pos") + 1).alias("pos"), F.when(F.col("decision") == "merge", F.col("confidence")).alias("merged"))
    rows = paragraphs.select("doc_id", "pos", "text").join(merged, ["doc_id", "pos"], "left")
    chained = rows.withColumn("chain", F.sum(F.when(F.col("merged").isNull(), 1).otherwise(0)).over(by_place()))
    # max_by() and the like would lose the order: positions go with the texts.
    found = chained.groupBy("doc_id", "chain").agg(F.min("pos").alias("first_pos"), F.count("pos").alias("n_rows"), F.max("merged").alias("confidence"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("own"))
    return found.select("doc_id", "first_pos", "n_rows", "confidence", tx.joined_fragments(F.transform("own", lambda x: x["text"])).alias("text"))


def runs(rows: DataFrame, key: Column) -> DataFrame:
    """Maximal runs of equal keys, null being a key: (doc_id, key, first_pos, length)."""
    keyed = rows.select("doc_id", "pos", key.alias("key"))
    changed = F.when(F.lag("pos").over(by_place()).isNull() | ~F.lag("key").over(by_place()).eqNullSafe(F.col("key")), 1).otherwise(0)
    return keyed.withColumn("run", F.sum(changed).over(by_place())).groupBy("doc_id", "run", "key").agg(F.min("pos").alias("first_pos"), F.count("pos").alias("length")).drop("run")


def nearest(rows: DataFrame, flag: Column) -> DataFrame:
    """For each row the nearest flagged place before and after it."""
    before = by_place().rowsBetween(Window.unboundedPreceding, -1)
    after = by_place().rowsBetween(1, Window.unboundedFollowing)
    at = F.when(flag, F.col("pos"))
    return rows.select("doc_id", "pos", F.last(at, True).over(before).alias("before_pos"), F.first(at, True).over(after).alias("after_pos"))


def ordered_pass(rows: DataFrame, read: list[str], added: str, kind: pa.DataType, start: Callable, step: Callable) -> DataFrame:
    """rows with a column that one pass over each document's ordered rows gives: value, state = step(state, *read), start() for a new document.

    For folds that no window expresses. One shuffle by doc_id, then a stream of sorted batches; what is held is one state.
    """
    spark = rows.sparkSession
    ship_package(spark)
    names = [*rows.columns, added]
    at = [rows.columns.index(c) for c in read]
    doc = rows.columns.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current = None, object()
        for batch in batches:
            out = []
            for own, values in zip(batch.column(doc).to_pylist(), zip(*[batch.column(k).to_pylist() for k in at], strict=True), strict=True):
                if own != current:
                    state, current = start(), own
                value, state = step(state, *values)
                out.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names)

    schema = rows.select("*", F.lit(None).cast("long" if pa.types.is_integer(kind) else "string").alias(added)).schema
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "pos").mapInArrow(run, schema)


def greedy_chunk(budget: int) -> Callable:
    """Chunk by characters, two for each separator: a row that doesn't fit starts the next chunk; a longer one stands alone."""

    def step(state, n):
        chunk, size = state
        n = n or 0
        if size >= 0 and size + 2 + n > budget:
            return chunk + 1, (chunk + 1, n)
        return chunk, (chunk, n if size < 0 else size + 2 + n)

    return step


def with_chunks(rows: DataFrame, budget: int) -> DataFrame:
    """rows and the chunk of each; a null text counts as empty."""
    sized = rows.withColumn("n", F.coalesce(F.length("text"), F.lit(0)))
    return ordered_pass(sized, ["n"], "chunk", pa.int64(), lambda: (0, -1), greedy_chunk(budget))


def greedy_chunks(rows: DataFrame, budget: int) -> DataFrame:
    """(doc_id, chunk, n_rows, n_chars)."""
    return with_chunks(rows.select("doc_id", "pos", "text"), budget).groupBy("doc_id", "chunk").agg(F.count("n").alias("n_rows"), (F.sum("n") + 2 * (F.count("n") - 1)).alias("n_chars"))


def chunk_context(rows: DataFrame, budget: int, before: int = 3, after: int = 3) -> DataFrame:
    """Each chunk's places with those of the rows read beside it, `before` and `after` of them: (doc_id, chunk, first_pos, last_pos, context_first, context_last)."""
    ends = with_chunks(rows.select("doc_id", "pos", "text"), budget).groupBy("doc_id", "chunk").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    last = F.max("last_pos").over(Window.partitionBy("doc_id"))
    return ends.select("doc_id", "chunk", "first_pos", "last_pos", F.greatest(F.col("first_pos") - before, F.lit(0)).alias("context_first"), F.least(F.col("last_pos") + after, last).alias("context_last"))


def positions(rows: DataFrame) -> DataFrame:
    """Place as a share of the document, four decimals; zero in a document of one row."""
    n = F.count("pos").over(Window.partitionBy("doc_id"))
    return rows.select("doc_id", "pos", F.when(n == 1, 0.0).otherwise(F.round(F.col("pos") / F.greatest(n - 1, F.lit(1)), 4)).alias("fraction"))


def toc_regions(paragraphs: DataFrame, least: int = 2) -> DataFrame:
    """A contents header with `least` entries or more right behind it: (doc_id, first_pos, n_entries)."""
    role = F.col("structural_role")
    start = F.sum(F.when(role == "toc_entry", 0).otherwise(1)).over(by_place())
    rows = paragraphs.select("doc_id", "pos", "structural_role", start.alias("run"))
    found = rows.groupBy("doc_id", "run").agg(F.min("pos").alias("first_pos"), F.max(F.when(role == "toc_header", 1).otherwise(0)).alias("headed"), F.sum(F.when(role == "toc_entry", 1).otherwise(0)).alias("n_entries"))
    return found.where((F.col("headed") == 1) & (F.col("n_entries") >= least)).select("doc_id", "first_pos", "n_entries")


def narration_groups(rows: DataFrame, is_body: Column) -> DataFrame:
    """Body lines joined where one is unfinished and the next begins in lower case: (doc_id, first_pos, n_rows)."""
    t, before = tx.strip(F.col("text")), tx.strip(F.lag("text").over(by_place()))
    was_body = F.lag("is_body").over(by_place())
    joins = was_body & F.col("is_body") & (t != "") & (before != "") & ~tx.like(before, r"[\d.!?…:;»”’\x22\x27)\]}]\z") & tx.like(t, r"^\p{Ll}")
    rows = rows.withColumn("is_body", is_body).withColumn("joins", F.coalesce(joins, F.lit(False)))
    return rows.withColumn("unit", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(by_place())).groupBy("doc_id", "unit").agg(F.min("pos").alias("first_pos"), F.count("pos").alias("n_rows")).drop("unit")


def apply_edits(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """Hash-guarded edits: a delete or a noise removal applies only where the block's hash is the one it was made for.

    blocks: (doc_id, pos, text); edits: (doc_id, pos, op, text_hash, noise), one a block. Returns every block
    with what became of it: text null if deleted, outcome applied, stale or none.
    """
    own = blocks.withColumn("own_hash", F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16))
    met = own.join(edits, ["doc_id", "pos"], "left")
    fresh = F.col("own_hash") == F.col("text_hash")
    outcome = F.when(F.col("op").isNull(), "none").when(~fresh, "stale").otherwise("applied")
    text = F.when((outcome == "applied") & (F.col("op") == "delete_block"), F.lit(None)).when((outcome == "applied") & (F.col("op") == "remove_noise"), F.replace("text", "noise")).otherwise(F.col("text"))
    return met.select("doc_id", "pos", outcome.alias("outcome"), text.alias("text"))
