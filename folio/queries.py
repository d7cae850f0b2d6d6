"""Every registered query of the library, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio import queries_edits, queries_more, queries_structure  # noqa: F401
from folio.functions import layout
from folio.functions import text as tx
from folio.operators import sequences as sq
from folio.operators import summaries as sm
from folio.registry import FORMS, LINES, ORACLES, PARAS, QUERIES, T, c, forms_of, lines_of, paras_of, query
from folio.sources.tables import table

__all__ = ["ORACLES", "QUERIES"]

SQUEEZE = str(tx.squeeze(T))
WORDS = r"list_filter(string_split(trim(regexp_replace({0}, '\s+', ' ', 'g')), ' '), lambda w: w <> '')"


def over_forms(name: str, make: Callable) -> None:
    """One text function over every row of the forms, as a column `value`."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return forms_of(spark, sf_dir).select("doc_id", "pos", make(F.col("text")).alias("value"))

    run.__name__ = name
    query(f"WITH {FORMS} SELECT doc_id, pos, {make(T)} AS value FROM m")(run)


def over_paras(name: str, make: Callable, *columns: str) -> None:
    """One rule over rows of the paragraph table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return paras_of(spark, sf_dir).select("doc_id", "pos", make(*[F.col(x) for x in columns]).alias("value"))

    run.__name__ = name
    query(f"WITH {PARAS} SELECT doc_id, pos, {make(*[c(x) for x in columns])} AS value FROM para")(run)


def over_pairs(name: str, make: Callable) -> None:
    """One rule over each row of the forms and the row before it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        before = forms_of(spark, sf_dir).withColumn("before", F.lag("text").over(sq.by_place())).where("before IS NOT NULL")
        return before.select("doc_id", "pos", make(F.col("before"), F.col("text")).alias("value"))

    run.__name__ = name
    query(f"WITH {FORMS}, w AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM m) SELECT doc_id, pos, {make(c('before'), T)} AS value FROM w WHERE before IS NOT NULL")(run)


# ---- normal forms ----
for _name, _make in {
    "text_squeeze": tx.squeeze, "text_strip_list_prefix": tx.strip_list_prefix, "text_outline_key": tx.outline_key, "text_layout_key": tx.layout_key, "text_mapping_key": tx.mapping_key, "text_heading_key": tx.heading_key,
    "text_heading_match_key": tx.heading_match_key, "text_toc_key": tx.toc_key, "text_heading_plain": tx.heading_plain, "text_running_header": tx.running_header, "text_preview": tx.preview, "text_halve_repeated": tx.halve_repeated,
    "text_homoglyphs": tx.homoglyphs, "text_blank_page_split": tx.blank_page_split, "text_without_images": tx.without_images, "text_visible": tx.visible_text, "text_identity": tx.identity_component, "text_unwrapped": tx.unwrapped,
    "text_structural": tx.structural_text, "text_token_key": lambda x: tx.joined(tx.tokens(x), " "),
    # ---- sentence edges ----
    "is_terminal": tx.ends_terminal, "is_incomplete": tx.ends_incomplete, "is_continuation": tx.starts_continuation, "is_sentence_start": tx.starts_sentence, "is_toc_entry": tx.is_toc_entry, "is_toc_heading": tx.is_toc_heading,
    "is_attribution": tx.is_attribution, "is_caption": tx.is_caption, "has_heading_signal": tx.heading_signal, "is_page_number": tx.is_page_number, "is_blank_notice": tx.is_blank_notice, "is_extraction_artifact": tx.is_artifact, "is_sentence": tx.is_sentence,
    # ---- blocks and lines ----
    "furniture_hits": tx.furniture_hits, "is_toc_like": tx.is_toc_like, "block_kind": tx.block_kind, "list_kind": tx.list_kind, "heading_level": tx.heading_level, "heading_level_guess": tx.likely_level, "index_density": tx.index_density, "is_index_like": tx.is_index_like,
    "is_untranslated_body": tx.is_untranslated_body, "is_untranslated_label": tx.is_untranslated_label, "is_bibliography": tx.is_bibliography, "is_furniture_text": tx.is_furniture_text, "is_part_divider": tx.is_part_divider, "is_body_prose": tx.is_body_prose, "is_index_row": tx.is_index_row,
    "is_page_reference": tx.is_page_reference, "is_label_line": tx.is_label_line, "is_substantive_line": tx.is_substantive, "has_page_suffix": tx.has_page_suffix, "is_heading_body_concat": tx.is_heading_body_concat, "is_epigraph_heading": lambda x: tx.is_epigraph_heading(x, None), "is_structural_label": tx.is_structural_label,
    "source_ends_sentence": tx.source_ends_sentence, "is_left_incomplete": tx.left_incomplete, "control_form": tx.control_form, "is_heading_only": tx.is_heading_only, "has_body_text": tx.has_body,
    "token_count": lambda x: tx.greatest(tx.floor(tx.length(x) / 4), 1),
}.items():
    over_forms(_name, _make)

# A glyph put before, between and within the words of every row.
over_forms("text_bullets", lambda x: tx.bullets(tx.plus("● ", x, " ●; 4●5 • end")))

over_paras("paragraph_role", tx.paragraph_role, "text", "style_name", "heading_level")
over_paras("role_confidence", tx.role_confidence, "role", "text", "style_name", "heading_level")
over_paras("style_heading_level", tx.style_level, "style_name")
over_paras("heading_role", lambda t, level: tx.heading_role(t, tx.first_of(level, 2)), "text", "heading_level")
over_paras("passthrough_form", tx.passthrough_form, "text", "role", "structural_role")
over_paras("text_rendered", lambda *a: tx.rendered(*a, tx.lit(1, a[0])), "text", "role", "structural_role", "heading_level", "list_kind")
over_paras("effective_role", lambda structural, role: tx.first_of(tx.nullif(structural, ""), tx.nullif(role, ""), "body"), "structural_role", "role")
over_paras("is_protected", layout.protected, "role", "structural_role")
over_paras("paragraph_plural", lambda n: tx.paragraph_words(n), "pos")
over_pairs("is_wrap_continuation", tx.continues_wrap)
over_pairs("block_verdicts", lambda before, x: tx.block_verdict(before, x))
over_pairs("joined_fragments", lambda before, x: tx.squeeze(tx.sub(tx.plus(tx.strip(before), " ", tx.strip(x)), rf"{tx.S}+([,.;:!?…])", r"\1")))


def scripts(x):
    """Dominant script of an excerpt, and whether another one has five characters and a tenth of its count."""
    latin, cyrillic, cjk = tx.script_counts(x)
    top = tx.greatest(latin, cyrillic, cjk)
    second = tx.case((top == latin, tx.greatest(cyrillic, cjk)), (top == cyrillic, tx.greatest(latin, cjk)), other=tx.greatest(latin, cyrillic))
    return {"latin": latin, "cyrillic": cyrillic, "cjk": cjk, "dominant": tx.case((top == 0, "unknown"), (top == latin, "latin"), (top == cyrillic, "cyrillic"), other="cjk"), "mixed": (second >= 5) & (second * 10 >= top - top % 10)}


@query(f"WITH {FORMS} SELECT doc_id, pos, {', '.join(f'{v} AS {k}' for k, v in scripts(T).items())} FROM m")
def script_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms_of(spark, sf_dir).select("doc_id", "pos", *[v.alias(k) for k, v in scripts(F.col("text")).items()])


@query(f"WITH s AS (SELECT doc_id, lang, {', '.join(f'{v} AS {k}' for k, v in scripts(tx.first_of(T, '')).items())} FROM documents) SELECT doc_id, dominant, mixed, CASE WHEN dominant = 'unknown' THEN NULL ELSE dominant = {tx.language_script(c('lang'))} END AS fits_language FROM s")
def script_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scripts(F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", found["dominant"].alias("dominant"), found["mixed"].alias("mixed"))
    return rows.select("doc_id", "dominant", "mixed", F.when(F.col("dominant") != "unknown", F.col("dominant") == tx.language_script(F.col("lang"))).alias("fits_language"))


HEADING = str(tx.heading_level(T).isNotNull())


@query(f"""WITH {FORMS}, h AS (SELECT doc_id, pos, CASE WHEN {HEADING} THEN pos END AS head_pos FROM m)
    SELECT doc_id, pos, max(head_pos) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_pos,
           min(head_pos) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after_pos FROM h""")
def nearest_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.nearest(forms_of(spark, sf_dir), tx.heading_level(F.col("text")).isNotNull())


@query(f"""WITH {FORMS}, h AS (SELECT doc_id, pos, {HEADING} AS head FROM m), s AS (SELECT doc_id, pos AS start, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), 2147483647) AS next FROM h WHERE head)
    SELECT h.doc_id, h.pos, s.start FROM h JOIN s ON h.doc_id = s.doc_id AND h.pos >= s.start AND h.pos < s.next""")
def segment_of_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range join of rows and their segments, as the last heading seen: one window, no join."""
    rows = forms_of(spark, sf_dir)
    start = F.last(F.when(tx.heading_level(F.col("text")).isNotNull(), F.col("pos")), True).over(sq.by_place().rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("doc_id", "pos", start.alias("start")).where("start IS NOT NULL")


RUNS = "k AS (SELECT doc_id, pos, {0} AS key FROM {1}), r AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS g FROM k)"


@query(f"WITH {FORMS}, {RUNS.format(tx.block_kind(T), 'm')} SELECT doc_id, key, min(pos) AS first_pos, count(*) AS length FROM r GROUP BY doc_id, key, g")
def kind_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.runs(forms_of(spark, sf_dir), tx.block_kind(F.col("text")))


CHUNKS = """, w AS (
      SELECT doc_id, pos, length(text) AS n, 0 AS chunk, length(text) AS size FROM m WHERE pos = 0
      UNION ALL SELECT m.doc_id, m.pos, length(m.text), CASE WHEN w.size + 2 + length(m.text) <= 2000 THEN w.chunk ELSE w.chunk + 1 END,
             CASE WHEN w.size + 2 + length(m.text) <= 2000 THEN w.size + 2 + length(m.text) ELSE length(m.text) END
      FROM w JOIN m ON m.doc_id = w.doc_id AND m.pos = w.pos + 1)"""


@query(f"WITH RECURSIVE {FORMS}{CHUNKS} SELECT doc_id, chunk, count(*) AS n_rows, sum(n) + 2 * (count(*) - 1) AS n_chars FROM w GROUP BY doc_id, chunk")
def chunk_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.greedy_chunks(forms_of(spark, sf_dir), 2000)


@query(f"""WITH RECURSIVE {FORMS}{CHUNKS}, e AS (SELECT doc_id, chunk, min(pos) AS first_pos, max(pos) AS last_pos FROM w GROUP BY doc_id, chunk)
    SELECT *, greatest(first_pos - 3, 0) AS context_first, least(last_pos + 3, max(last_pos) OVER (PARTITION BY doc_id)) AS context_last FROM e""")
def chunk_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.chunk_context(forms_of(spark, sf_dir), 2000)


@query(f"""WITH {LINES}, s AS (SELECT doc_id, pos, {tx.layout_key(T)} AS key FROM p)
    SELECT doc_id, key, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos, round((max(pos) - min(pos))::DOUBLE / (count(*) - 1), 4) AS mean_gap
    FROM s WHERE key <> '' AND length(key) <= 80 GROUP BY doc_id, key HAVING count(*) >= 2""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.repeated_lines(lines_of(spark, sf_dir), 2)


REPORT = f"""{PARAS}, rep AS (SELECT doc_id, count(*) AS n_rows, count(*) FILTER (role = 'heading') AS headings, count(*) FILTER (role = 'list') AS lists,
    count(*) FILTER ({tx.is_page_number(T)}) AS page_numbers, sum(length(text)) AS chars, max(length(text)) AS longest, round(count(*) FILTER (role = 'heading')::DOUBLE / count(*), 4) AS heading_share FROM para GROUP BY doc_id)"""


@query(f"WITH {REPORT} SELECT * FROM rep")
def document_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.document_report(paras_of(spark, sf_dir))


@query(f"""WITH {REPORT} SELECT doc_id, concat_ws(',', CASE WHEN headings > 0 AND NOT heading_share <= 0.3 THEN 'few_headings' END, CASE WHEN NOT longest <= 2000 THEN 'longest' END, CASE WHEN n_rows >= 5 AND NOT page_numbers = 0 THEN 'page_numbers' END) AS failed,
    CASE WHEN (headings > 0 AND NOT heading_share <= 0.3) OR NOT longest <= 2000 OR (n_rows >= 5 AND NOT page_numbers = 0) THEN 'fail' ELSE 'pass' END AS verdict FROM rep""")
def acceptance_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col
    checks = {"few_headings": (x("headings") > 0, x("heading_share") <= 0.3), "longest": (F.lit(True), x("longest") <= 2000), "page_numbers": (x("n_rows") >= 5, x("page_numbers") == 0)}
    return sm.check_table(sm.document_report(paras_of(spark, sf_dir)), checks).select("doc_id", "failed", "verdict")


@query(f"WITH {FORMS}, s AS (SELECT doc_id, pos, {tx.block_kind(T)} AS kind FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos) AS nth FROM s) SELECT doc_id, kind, pos, nth FROM r WHERE nth <= 3")
def first_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = forms_of(spark, sf_dir).select("doc_id", "pos", tx.block_kind(F.col("text")).alias("kind"))
    return own.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("pos"))).where("nth <= 3")


@query("SELECT l_orderkey, l_linenumber, o_orderstatus, o_orderkey IS NOT NULL AS found FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def registry_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return rows.join(source, rows.l_orderkey == source.o_orderkey, "left").select("l_orderkey", "l_linenumber", "o_orderstatus", F.col("o_orderkey").isNotNull().alias("found"))


@query(f"WITH {LINES} SELECT doc_id, pos, CASE WHEN count(*) OVER (PARTITION BY doc_id) = 1 THEN 0 ELSE round(pos::DOUBLE / (count(*) OVER (PARTITION BY doc_id) - 1), 4) END AS fraction FROM p")
def position_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.positions(lines_of(spark, sf_dir))


@query("SELECT user_id, event_type, count(*) AS calls, round(sum(value), 4) AS cost, count(value) AS costed FROM events GROUP BY GROUPING SETS ((user_id, event_type), (user_id))")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.usage_rollup(table(spark, sf_dir, "events"), "user_id", "event_type", "value")


@query("""SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id DESC) AS rank FROM events WHERE value <= 50) WHERE rank <= 5""")
def retained_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.retained(table(spark, sf_dir, "events"), "user_id", "value", "event_id", 5, 50.0).select("user_id", "event_id", "rank")


@query("""WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL), b AS (SELECT p_brand, first(p_size ORDER BY n DESC, p_size) AS base FROM c GROUP BY p_brand), m AS (SELECT * FROM c JOIN b USING (p_brand))
    SELECT p_brand, p_size, n, base, CASE WHEN p_size > base + 0.25 THEN dense_rank() OVER (PARTITION BY p_brand, p_size > base + 0.25 ORDER BY p_size DESC) WHEN abs(p_size - base) <= 0.25 THEN 0 ELSE -1 END AS tier FROM m""")
def font_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.mode_tiers(table(spark, sf_dir, "part"), "p_brand", "p_size")


@query("SELECT p_partkey, p_brand, CASE WHEN s < 1e-9 THEN 0 ELSE round((p_size - a) / s, 1) + 0 END AS z FROM part JOIN (SELECT p_brand, avg(p_size) AS a, stddev_pop(p_size) AS s FROM part GROUP BY p_brand) USING (p_brand)")
def font_z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.z_scores(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "p_brand", "p_size").drop("p_size")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def uncovered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey").join(table(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query(f"""WITH t AS (SELECT conv_id, turn, list_distinct({WORDS.format("lower(coalesce(text, ''))")}) AS w, lag(list_distinct({WORDS.format("lower(coalesce(text, ''))")})) OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM conversations)
    SELECT conv_id, turn, len(list_intersect(w, v)) AS shared, CASE WHEN len(list_distinct(w || v)) = 0 THEN 0 ELSE round(len(list_intersect(w, v))::DOUBLE / len(list_distinct(w || v)), 4) END AS jaccard FROM t WHERE v IS NOT NULL""")
def turn_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(tx.words(F.lower(F.coalesce("text", F.lit(""))))).alias("w"))
    pairs = own.withColumn("v", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("v IS NOT NULL")
    return pairs.select("conv_id", "turn", F.size(F.array_intersect("w", "v")).alias("shared"), sm.jaccard(F.col("w"), F.col("v")).alias("jaccard"))


@query("""WITH r AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS g FROM conversations) SELECT conv_id, role, min(turn) AS first_pos, count(*) AS length FROM r GROUP BY conv_id, role, g""")
def role_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "role")
    return sq.runs(rows, F.col("role")).select(F.col("doc_id").alias("conv_id"), F.col("key").alias("role"), "first_pos", "length")


@query("""WITH s AS (SELECT conv_id, avg(length(coalesce(text, ''))) FILTER (role = 'user') AS a, avg(length(coalesce(text, ''))) FILTER (role = 'assistant') AS b FROM conversations GROUP BY conv_id)
    SELECT CASE WHEN a > b THEN 'user' WHEN a < b THEN 'assistant' ELSE 'tie' END AS winner, count(*) AS n, sum(CASE WHEN a > b THEN 1 WHEN a < b THEN 0 ELSE 0.5 END)::DOUBLE AS credit FROM s GROUP BY ALL""")
def pairwise_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length(F.coalesce("text", F.lit("")))
    s = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.avg(F.when(F.col("role") == "user", n)).alias("a"), F.avg(F.when(F.col("role") == "assistant", n)).alias("b"))
    won, lost = F.col("a") > F.col("b"), F.col("a") < F.col("b")
    return s.select(F.when(won, "user").when(lost, "assistant").otherwise("tie").alias("winner"), F.when(won, 1.0).when(lost, 0.0).otherwise(0.5).alias("c")).groupBy("winner").agg(F.count("c").alias("n"), F.sum("c").alias("credit"))


@query("SELECT doc_id, coalesce(lang, '') || ':' || length(coalesce(text, '')) || ':' || sha256(coalesce(text, '')) AS token FROM documents")
def source_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(":", F.coalesce("lang", F.lit("")), F.length(t).cast("string"), F.sha2(t.cast("binary"), 256)).alias("token"))


@query("""WITH x AS (SELECT user_id, ts, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth, count(*) OVER (PARTITION BY user_id) AS seen FROM events) SELECT user_id, event_id, event_type, seen FROM x WHERE nth = 1""")
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each key by one partial aggregate, not a sort."""
    best = F.max(F.struct("ts", "event_id", "event_type")).alias("m")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(best, F.count(F.lit(1)).alias("seen")).select("user_id", "m.event_id", "m.event_type", "seen")