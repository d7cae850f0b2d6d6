"""Queries over blocks and operation logs, alignments, statistics and retention, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as tx
from folio.functions.core import plus, swapped
from folio.operators import align, edits
from folio.operators import sequences as sq
from folio.operators import statistics as st
from folio.operators import summaries as sm
from folio.registry import FORMS, PARAS, T, c, forms_of, named_sql, paras_of, query
from folio.sources.tables import blocks, table

BLOCKS = f"""{FORMS}, kinds AS (SELECT doc_id, pos, text, 'b_' || lpad(pos::VARCHAR, 6, '0') AS block_id, {tx.short_hash(tx.strip(T))} AS text_hash, length(text) AS char_count, length(regexp_replace(text, '\\s', '', 'g')) AS solid_count, {tx.block_kind(T)} AS kind FROM m),
b AS MATERIALIZED (SELECT *, kind = 'heading' AS is_heading, kind = 'toc_like' AS is_toc_like FROM kinds)"""


def blocks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forms_of(spark, sf_dir)
    return blocks(rows).join(rows, ["doc_id", "pos"])


@query(f"WITH {BLOCKS} SELECT doc_id, pos, block_id, text_hash, char_count, solid_count, kind, is_heading, is_toc_like FROM b")
def cleanup_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(forms_of(spark, sf_dir))


PLAN = f"""{BLOCKS}, keys AS (SELECT doc_id, kind, {tx.strip(T)} AS key FROM b WHERE char_count BETWEEN 1 AND 120 AND NOT is_heading AND NOT is_toc_like),
plan AS MATERIALIZED (SELECT doc_id, key, count(*) AS n, any_value(kind) AS kind FROM keys GROUP BY doc_id, key HAVING count(*) >= 2)"""


@query(f"WITH {PLAN} SELECT doc_id, key, n, CASE WHEN n >= 3 THEN 'high' ELSE 'medium' END AS confidence, {tx.noise_reason(c('key'), c('kind'))} AS reason FROM plan")
def repeated_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.global_plan(blocks_of(spark, sf_dir))


GUARDED = f"""{PLAN}, g AS MATERIALIZED (SELECT b.*, plan.key IS NOT NULL AS is_candidate, {tx.strip(c("b.text"))} <> '' AS filled FROM b LEFT JOIN plan ON plan.doc_id = b.doc_id AND plan.key = {tx.strip(c("b.text"))}),
guarded AS MATERIALIZED (SELECT *, coalesce(pos = min(CASE WHEN filled THEN pos END) OVER d OR pos = max(CASE WHEN filled THEN pos END) OVER d, FALSE) OR is_toc_like AS is_protected,
  coalesce(lag(is_candidate OR kind IN ('blank_page_marker', 'extraction_artifact')) OVER o, FALSE) OR coalesce(lead(is_candidate OR kind IN ('blank_page_marker', 'extraction_artifact')) OVER o, FALSE) AS near_furniture
  FROM g WINDOW d AS (PARTITION BY doc_id), o AS (PARTITION BY doc_id ORDER BY pos))"""


@query(f"WITH {GUARDED} SELECT doc_id, pos, is_candidate, is_protected, near_furniture FROM guarded")
def block_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.guarded_blocks(blocks_of(spark, sf_dir)).select("doc_id", "pos", "is_candidate", "is_protected", "near_furniture")


# An operation on every third block: its kind by place, a wrong hash in every third document.
def log_columns(doc, pos, text, kind):
    k = (doc + pos) % 7
    return {
        "seq": pos * 1,
        "operation": tx.case((k <= 3, "delete_block"), (k == 4, "split_block"), (k == 5, "remove_inline_noise"), other="join_fragmented_paragraph"),
        "reason": tx.case((k == 0, kind), (k == 1, "page_number"), (k == 2, "repeated_running_header"), (k == 3, "page_furniture_heading"), other="repeated_running_header"),
        "confidence": tx.case((pos % 11 == 0, "low"), (pos % 2 == 0, "high"), other="medium"),
        "made_for": tx.case((doc % 3 == 0, plus(tx.strip(text), "x")), other=tx.strip(text)),
    }


LOG = f"ops AS MATERIALIZED (SELECT doc_id, pos, {named_sql(log_columns(c('doc_id'), c('pos'), T, c('kind')))} FROM b WHERE pos % 3 = 0), log AS (SELECT *, {tx.short_hash(c('made_for'))} AS op_hash FROM ops)"


def log_of(rows: DataFrame) -> DataFrame:
    made = log_columns(F.col("doc_id"), F.col("pos"), F.col("text"), F.col("kind"))
    return rows.where("pos % 3 = 0").select("doc_id", "pos", *[v.alias(k) for k, v in made.items()]).withColumn("text_hash", tx.short_hash(F.col("made_for")))


KINDS = ", ".join(f"'{k}'" for k in edits.KIND_REASONS)
REFUSED = f"""CASE WHEN op_hash <> text_hash THEN 'text_hash_mismatch' WHEN confidence = 'low' THEN 'low_confidence'
  WHEN operation <> 'delete_block' THEN CASE WHEN kind = 'footnote_body' THEN 'footnote_body_protected' WHEN is_toc_like THEN 'toc_protected' WHEN is_protected THEN 'protected_block' END
  WHEN {tx.like(T, tx.IMAGE)} THEN 'docx_image_anchor_protected' WHEN reason IN ({KINDS}) AND kind <> reason THEN 'reason_kind_incompatible' WHEN kind = 'footnote_body' THEN 'footnote_body_protected'
  WHEN reason = 'repeated_running_header' AND NOT is_candidate THEN 'missing_repetition_evidence' WHEN reason = 'repeated_running_header' AND kind NOT IN ('paragraph', {KINDS}) THEN 'reason_kind_incompatible'
  WHEN reason = 'page_furniture_heading' AND kind <> 'heading' THEN 'reason_kind_incompatible' WHEN reason = 'page_furniture_heading' AND confidence <> 'high' THEN 'heading_protected'
  WHEN is_heading AND NOT (reason IN ('repeated_running_header', 'page_furniture_heading') AND confidence = 'high') THEN 'heading_protected' WHEN is_protected THEN 'protected_block'
  WHEN reason = 'page_number' AND regexp_full_match({tx.strip(T)}, '\\d{{1,4}}') AND NOT near_furniture THEN 'standalone_number_delete_requires_page_context' WHEN char_count > 300 THEN 'block_char_limit_exceeded' END"""
CHECKED = f"{GUARDED}, {LOG}, checked AS MATERIALIZED (SELECT doc_id, pos, seq, operation, {REFUSED} AS refused FROM log JOIN guarded USING (doc_id, pos))"


@query(f"WITH {CHECKED} SELECT * FROM checked")
def edit_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks_of(spark, sf_dir)
    return edits.validated(rows, log_of(rows))


SAFE = """, gone AS (SELECT doc_id, pos FROM checked WHERE refused IS NULL AND operation = 'delete_block'), isl AS (SELECT doc_id, max(n) AS longest_run FROM (SELECT doc_id, i, count(*) AS n FROM (SELECT doc_id, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM gone) GROUP BY doc_id, i) GROUP BY doc_id),
s AS (SELECT b.doc_id, count(*) AS n_blocks, count(gone.pos) AS n_deleted, sum(solid_count) AS chars, coalesce(sum(solid_count) FILTER (gone.pos IS NOT NULL), 0) AS gone_chars FROM b LEFT JOIN gone USING (doc_id, pos) GROUP BY b.doc_id),
cost AS MATERIALIZED (SELECT doc_id, n_blocks, n_deleted, CASE WHEN n_blocks = 0 THEN 0 ELSE round(n_deleted::DOUBLE / n_blocks, 6) END AS block_ratio, CASE WHEN chars = 0 THEN 0 ELSE round(gone_chars::DOUBLE / chars, 6) END AS char_ratio, coalesce(longest_run, 0) AS longest_run,
  n_deleted > n_blocks * 0.03 OR gone_chars > chars * 0.05 OR coalesce(longest_run, 0) > 3 AS violates FROM s LEFT JOIN isl USING (doc_id))"""


@query(f"WITH {CHECKED}{SAFE} SELECT * FROM cost")
def edit_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks_of(spark, sf_dir)
    checked = edits.validated(rows, log_of(rows))
    return edits.safety(rows, checked.where("refused IS NULL AND operation = 'delete_block'"))


@query(f"WITH {CHECKED}{SAFE} SELECT doc_id, pos, seq, operation FROM checked LEFT JOIN cost USING (doc_id) WHERE refused IS NULL AND (operation <> 'delete_block' OR NOT coalesce(violates, FALSE))")
def edits_without_unsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks_of(spark, sf_dir)
    checked = edits.validated(rows, log_of(rows))
    return edits.without_unsafe_deletes(checked, edits.safety(rows, checked.where("refused IS NULL AND operation = 'delete_block'")))


# Every block twice in the log, its operations by place.
def twice(doc, pos):
    name = lambda k: tx.case((k == 0, "delete_block"), (k == 1, "split_block"), (k == 2, "remove_inline_noise"), (k == 3, "join_fragmented_paragraph"), (k == 4, "normalize_heading_boundary"), other="remove_inline_noise")
    return name((doc + pos) % 6), name((doc * 2 + pos) % 5)


_ONE, _TWO = twice(c("doc_id"), c("pos"))
PHASE = "CASE operation " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in edits.PHASES.items()) + " END"


@query(f"""WITH {FORMS}, l AS (SELECT doc_id, pos, 0 AS seq, {_ONE} AS operation FROM m UNION ALL SELECT doc_id, pos, 1, {_TWO} FROM m), f AS (SELECT *, {PHASE} AS phase FROM l),
    o AS (SELECT *, max(CASE WHEN operation = 'delete_block' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, pos) AS deletes, lag(operation) OVER (PARTITION BY doc_id, pos ORDER BY phase, seq) AS prior FROM f)
    SELECT doc_id, pos, seq, operation, phase, CASE WHEN coalesce(prior = operation AND operation <> 'remove_inline_noise', FALSE) OR (deletes = 1 AND operation <> 'delete_block') THEN 'duplicate_operation_incompatible' END AS refused FROM o""")
def edit_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = twice(F.col("doc_id"), F.col("pos"))
    both = F.array(F.struct(F.lit(0).alias("seq"), a.alias("operation")), F.struct(F.lit(1).alias("seq"), b.alias("operation")))
    return edits.in_sequence(forms_of(spark, sf_dir).select("doc_id", "pos", F.inline(both)))


# What the operations of the log do to their blocks: halves as parts, the first word of three as noise, the next block's hash.
APPLY = f"""{CHECKED}, ap AS (SELECT b.doc_id, b.pos, b.text, b.text_hash, o.operation, left(b.text, length(b.text) // 2) AS one, substr(b.text, length(b.text) // 2 + 1) AS two,
   lead(b.text) OVER w AS next_text, lead(b.text_hash) OVER w AS next_hash, lead(o.operation) OVER w AS next_operation FROM b LEFT JOIN (SELECT * FROM checked WHERE refused IS NULL) o USING (doc_id, pos) WINDOW w AS (PARTITION BY b.doc_id ORDER BY b.pos)),
 j AS (SELECT *, coalesce(operation = 'join_fragmented_paragraph' AND next_hash IS NOT NULL AND next_operation IS NULL, FALSE) AS joins, {tx.squeeze(c("replace(text, 'e', ' ')"))} AS clean, length(text) - length(replace(text, 'e', '')) = 1 AS once FROM ap),
 k AS (SELECT *, coalesce(lag(joins) OVER (PARTITION BY doc_id ORDER BY pos), FALSE) AS joined FROM j),
 z AS (SELECT *, CASE WHEN joined THEN 'joined_with_previous' WHEN operation IS NULL THEN 'none' WHEN operation = 'delete_block' THEN 'deleted' WHEN operation = 'split_block' THEN 'split'
   WHEN operation = 'remove_inline_noise' AND once AND length(regexp_replace(clean, '\\s+', '', 'g')) >= 20 THEN 'inline_noise_removed' WHEN joins THEN 'joined_with_next' ELSE 'not_applicable' END AS outcome FROM k)
 SELECT doc_id, pos, outcome, CASE outcome WHEN 'joined_with_previous' THEN NULL WHEN 'deleted' THEN NULL WHEN 'split' THEN one || chr(10) || chr(10) || two WHEN 'inline_noise_removed' THEN clean
   WHEN 'joined_with_next' THEN {tx.rstrip(T)} || ' ' || {tx.lstrip(c("next_text"))} ELSE text END AS text FROM z"""


@query(f"WITH {APPLY}")
def edits_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks_of(spark, sf_dir)
    accepted = edits.validated(rows, log_of(rows)).where("refused IS NULL").select("doc_id", "pos", "operation")
    half = F.floor(F.length("text") / 2).cast("int")
    made = rows.select("doc_id", "pos", F.array(F.substring("text", F.lit(1), half), F.substr("text", half + 1)).alias("parts"), F.lit("e").alias("noise"), F.lead("text_hash").over(edits.by_place()).alias("next_hash"))
    return edits.applied(rows, accepted.join(made, ["doc_id", "pos"]))


@query(f"""WITH {FORMS}, e AS (SELECT doc_id, pos, CASE WHEN pos % 5 = 0 THEN 'delete_block' ELSE 'remove_noise' END AS op, substr(sha256(CASE WHEN doc_id % 3 = 0 THEN text || 'x' ELSE text END), 1, 16) AS text_hash, 'the' AS noise FROM m WHERE pos % 5 IN (0, 2)),
    x AS (SELECT m.doc_id, m.pos, m.text, e.op, CASE WHEN e.op IS NULL THEN 'none' WHEN substr(sha256(m.text), 1, 16) <> e.text_hash THEN 'stale' ELSE 'applied' END AS outcome FROM m LEFT JOIN e USING (doc_id, pos))
    SELECT doc_id, pos, outcome, CASE WHEN outcome = 'applied' AND op = 'delete_block' THEN NULL WHEN outcome = 'applied' THEN replace(text, 'the', '') ELSE text END AS text FROM x""")
def apply_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forms_of(spark, sf_dir)
    made_for = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    op = F.when(F.col("pos") % 5 == 0, "delete_block").otherwise("remove_noise")
    made = rows.where("pos % 5 IN (0, 2)").select("doc_id", "pos", op.alias("op"), tx.short_hash(made_for).alias("text_hash"), F.lit("the").alias("noise"))
    return sq.apply_edits(rows, made)


@query(f"""WITH {FORMS}, r AS (SELECT doc_id, pos, text, ['heading', 'body', 'list_item'][(doc_id + pos) % 3 + 1] AS role FROM m WHERE pos % 2 = 0), v AS (SELECT *, {tx.strip(c(f"regexp_replace({tx.strip(T)}, '^#+', '')"))} AS seen, {tx.like(T, tx.IMAGE)} AS anchor FROM r),
    x AS (SELECT *, CASE WHEN role = 'heading' THEN '## ' || seen WHEN role = 'list_item' AND NOT regexp_matches(seen, '^(?:[-*]|\\d+\\.)\\s+') THEN '- ' || seen ELSE seen END AS made FROM v)
    SELECT doc_id, pos, CASE WHEN anchor THEN 'docx_image_anchor_protected' WHEN made = text THEN 'unchanged' ELSE 'reannotated' END AS outcome, CASE WHEN anchor THEN text ELSE made END AS text FROM x""")
def reannotated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forms_of(spark, sf_dir)
    roles = F.get(F.array(F.lit("heading"), F.lit("body"), F.lit("list_item")), ((F.col("doc_id") + F.col("pos")) % 3).cast("int"))
    return edits.reannotated(rows, rows.where("pos % 2 = 0").select("doc_id", "pos", F.lit(0).alias("seq"), roles.alias("role")))


CAPITALS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


# ---- alignment: the target has the source's rows but every seventh, some in capitals, and names every fifth ----
SIDES = f"""{PARAS}, kept AS (SELECT doc_id, pos, CASE WHEN pos % 9 = 4 THEN 'altered ' || text WHEN pos % 5 = 1 THEN {swapped(T, *CAPITALS)} ELSE text END AS text FROM para WHERE pos % 7 <> 3 OR doc_id % 4 = 0),
tgt AS MATERIALIZED (SELECT doc_id, pos AS from_pos, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INTEGER AS target, text FROM kept),
src0 AS MATERIALIZED (SELECT doc_id, pos, text, role, structural_role, {tx.mapping_key(T)} AS key FROM para), tk AS MATERIALIZED (SELECT *, {tx.mapping_key(T)} AS key FROM tgt)"""
PASS1 = """d1 AS MATERIALIZED (SELECT doc_id, pos, target, 'paragraph_id_rebuild_key' AS strategy FROM (SELECT s.doc_id, s.pos, t.target, row_number() OVER (PARTITION BY s.doc_id, t.target ORDER BY s.pos) AS nth
  FROM src0 s JOIN tk t ON s.doc_id = t.doc_id AND s.pos = t.from_pos WHERE s.pos % 5 = 0 AND s.role <> 'image' AND s.key = t.key AND s.key <> '') WHERE nth = 1)"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    source = paras_of(spark, sf_dir).select("doc_id", "pos", "text", "role", "structural_role")
    changed = F.when(F.col("pos") % 9 == 4, F.concat(F.lit("altered "), "text")).when(F.col("pos") % 5 == 1, swapped(F.col("text"), *CAPITALS)).otherwise(F.col("text"))
    kept = source.where("pos % 7 <> 3 OR doc_id % 4 = 0").select("doc_id", "pos", changed.alias("text"))
    target = kept.select("doc_id", F.col("pos").alias("from_pos"), (F.row_number().over(align.by_place()) - 1).alias("target"), "text")
    return source, target.drop("from_pos"), target.where("from_pos % 5 = 0").select("doc_id", F.col("from_pos").alias("pos"), "target")


@query(f"WITH {SIDES}, {PASS1} SELECT * FROM d1")
def align_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.by_declared_index(*sides(spark, sf_dir))


EXACT = "SELECT l.doc_id, l.pos, r.target, 'exact_text' AS strategy FROM (SELECT doc_id, key, min(pos) AS pos FROM {0} WHERE key <> '' GROUP BY doc_id, key HAVING count(*) = 1) l JOIN (SELECT doc_id, key, min(target) AS target FROM {1} WHERE key <> '' GROUP BY doc_id, key HAVING count(*) = 1) r USING (doc_id, key)"


@query(f"WITH {SIDES} {EXACT.format('src0', 'tk')}")
def align_exact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target, _ = sides(spark, sf_dir)
    return align.by_exact_text(source, target)


ALIGNED = f"""{SIDES}, {PASS1}, w1 AS (SELECT s.*, d.target AS mapped, lag(s.role) OVER o AS before, lag(d.target) OVER o AS anchor FROM src0 s LEFT JOIN d1 d USING (doc_id, pos) WINDOW o AS (PARTITION BY s.doc_id ORDER BY s.pos)),
 c2 AS (SELECT w.doc_id, w.pos, t.target FROM w1 w JOIN tk t ON t.doc_id = w.doc_id AND t.target = w.anchor + 1 WHERE w.mapped IS NULL AND w.before IN ('image', 'table') AND NOT EXISTS (SELECT 1 FROM d1 WHERE d1.doc_id = t.doc_id AND d1.target = t.target) AND ({tx.is_caption(c("t.text"))} OR t.key = w.key)),
 d2 AS MATERIALIZED (SELECT doc_id, pos, target, 'adjacent_caption' AS strategy FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, pos) AS a, count(*) OVER (PARTITION BY doc_id, target) AS b FROM c2) WHERE a = 1 AND b = 1),
 t2 AS MATERIALIZED (SELECT * FROM d1 UNION ALL SELECT * FROM d2), sl AS MATERIALIZED (SELECT * FROM src0 s WHERE NOT EXISTS (SELECT 1 FROM t2 WHERE t2.doc_id = s.doc_id AND t2.pos = s.pos)), tl AS MATERIALIZED (SELECT * FROM tk t WHERE NOT EXISTS (SELECT 1 FROM t2 WHERE t2.doc_id = t.doc_id AND t2.target = t.target)),
 t3 AS MATERIALIZED (SELECT * FROM t2 UNION ALL {EXACT.format('sl', 'tl')}),
 eq AS (SELECT a.doc_id FROM (SELECT doc_id, count(*) AS n FROM src0 GROUP BY doc_id) a JOIN (SELECT doc_id, count(*) AS n FROM tk GROUP BY doc_id) b ON a.doc_id = b.doc_id AND a.n = b.n),
 d4 AS (SELECT s.doc_id, s.pos, t.target, CASE WHEN s.key = t.key AND s.key <> '' THEN 'positional_exact' ELSE 'positional_toc_fallback' END AS strategy FROM src0 s JOIN eq USING (doc_id) JOIN tk t ON t.doc_id = s.doc_id AND t.target = s.pos
   WHERE NOT EXISTS (SELECT 1 FROM t3 WHERE t3.doc_id = s.doc_id AND t3.pos = s.pos) AND NOT EXISTS (SELECT 1 FROM t3 WHERE t3.doc_id = t.doc_id AND t3.target = t.target) AND ((s.key = t.key AND s.key <> '') OR (s.structural_role IN ('toc_header', 'toc_entry') AND {tx.strip(c("t.text"))} <> ''))),
 al AS MATERIALIZED (SELECT * FROM t3 UNION ALL SELECT * FROM d4)"""


@query(f"WITH {ALIGNED} SELECT * FROM al")
def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned(*sides(spark, sf_dir))


@query(f"""WITH {ALIGNED}, a AS (SELECT doc_id, count(*) AS sources FROM src0 GROUP BY doc_id), b AS (SELECT doc_id, count(*) AS targets FROM tk GROUP BY doc_id), n AS (SELECT doc_id, count(*) AS pairs FROM al GROUP BY doc_id)
    SELECT doc_id, sources, coalesce(targets, 0) AS targets, coalesce(pairs, 0) AS pairs, sources - coalesce(pairs, 0) AS unmapped_sources, coalesce(targets, 0) - coalesce(pairs, 0) AS unmapped_targets FROM a LEFT JOIN b USING (doc_id) LEFT JOIN n USING (doc_id)""")
def alignment_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target, declared = sides(spark, sf_dir)
    return align.coverage(source, target, align.aligned(source, target, declared))


@query(f"""WITH {SIDES}, {PASS1}, r AS (SELECT s.doc_id, s.pos, d.target, max(CASE WHEN d.target IS NOT NULL THEN s.pos END) OVER lo AS lp, min(CASE WHEN d.target IS NOT NULL THEN s.pos END) OVER hi AS hp FROM src0 s LEFT JOIN d1 d USING (doc_id, pos)
      WINDOW lo AS (PARTITION BY s.doc_id ORDER BY s.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), hi AS (PARTITION BY s.doc_id ORDER BY s.pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    x AS (SELECT r.*, l.target AS lt, h.target AS ht FROM r LEFT JOIN d1 l ON l.doc_id = r.doc_id AND l.pos = r.lp LEFT JOIN d1 h ON h.doc_id = r.doc_id AND h.pos = r.hp WHERE r.target IS NULL)
    SELECT doc_id, pos, CASE WHEN lp IS NOT NULL AND hp IS NOT NULL THEN lt + round((ht - lt) * (pos - lp) / (hp - lp)::DOUBLE) WHEN lp IS NOT NULL THEN lt + pos - lp WHEN hp IS NOT NULL THEN ht - (hp - pos) END::BIGINT AS projected FROM x""")
def projected_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target, declared = sides(spark, sf_dir)
    return align.projected(source, align.by_declared_index(source, target, declared))


_A, _B = tx.mapping_key(c("text")), tx.mapping_key(c("after"))


@query(f"""WITH {FORMS}, n AS (SELECT doc_id, pos, text, lead(text) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM m), k AS (SELECT doc_id, pos, {_A} AS a, {_B} AS b FROM n WHERE after IS NOT NULL), s AS (SELECT *, {tx.token_set(c('a'))} AS x, {tx.token_set(c('b'))} AS y FROM k),
    v AS (SELECT *, len(list_intersect(x, y)) AS common FROM s) SELECT doc_id, pos, common, CASE WHEN len(x) = 0 THEN 0 ELSE round(common::DOUBLE / len(x), 4) END AS overlap, CASE WHEN len(list_distinct(x || y)) = 0 THEN 0 ELSE round(common::DOUBLE / len(list_distinct(x || y)), 4) END AS jaccard,
      round(length(a)::DOUBLE / greatest(length(b), 1), 4) AS cover, a = b AND a <> '' AS is_exact, a <> b AND a <> '' AND contains(b, a) AS is_contained FROM v""")
def pair_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forms_of(spark, sf_dir).withColumn("after", F.lead("text").over(align.by_place())).where("after IS NOT NULL")
    return align.evidence(rows, "text", "after").drop("text", "after")


# ---- statistics ----
@query("""WITH v AS (SELECT l_returnflag, l_quantity::DOUBLE AS v, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY ALL), w AS (SELECT *, sum(n) OVER o AS ln, sum(v * n) OVER o AS ls, sum(n) OVER g AS an, sum(v * n) OVER g AS tot, lead(v) OVER o AS nv, max(v) OVER g AS top FROM v WINDOW o AS (PARTITION BY l_returnflag ORDER BY v), g AS (PARTITION BY l_returnflag)),
    b AS (SELECT *, CASE WHEN an > ln THEN round(ln * (an - ln) * power(ls / ln - (tot - ls) / (an - ln), 2), 6) END AS between_ FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY between_ DESC NULLS LAST, v) AS nth FROM b)
    SELECT l_returnflag, CASE WHEN an < 3 THEN top ELSE coalesce((v + nv) / 2, top) END AS threshold FROM r WHERE nth = 1""")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.otsu(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")


SHARES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p95": 0.95, "top": 1.0}


@query("WITH a AS (SELECT user_id, list_sort(list(value::DOUBLE) FILTER (value IS NOT NULL)) AS v FROM events GROUP BY user_id) SELECT user_id, len(v) AS n, " + ", ".join(f"round(v[round_even({s} * (len(v) - 1), 0)::INTEGER + 1], 4) AS {k}" for k, s in SHARES.items()) + " FROM a WHERE len(v) > 0")
def nearest_rank_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.nearest_rank(table(spark, sf_dir, "events"), "user_id", "value", SHARES)


@query("WITH h AS (SELECT p_brand, round_even(p_size::DOUBLE * 2, 0) / 2 AS v, count(*) AS n FROM part GROUP BY ALL) SELECT p_brand, first(v ORDER BY n DESC, v) AS mode FROM h GROUP BY p_brand")
def font_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.mode_of_halves(table(spark, sf_dir, "part"), "p_brand", "p_size")


# Paragraphs as spans: forty to a page, each at its height.
def span_columns(pos, font_size, style):
    return {"page": pos - pos % 20, "top": (pos % 20) * 40.0, "bottom": (pos % 20) * 40.0 + 30.0, "page_height": (pos * 0 + 1) * 800.0, "font_size": font_size, "is_bold": style == "Title"}


SPANS = f"{PARAS}, spans AS MATERIALIZED (SELECT doc_id, text, {named_sql(span_columns(c('pos'), c('font_size'), c('style_name')))} FROM para), z AS MATERIALIZED (SELECT *, lower({tx.squeeze(T)}) AS key, CASE WHEN top <= 80 OR bottom <= 80 THEN 'top' WHEN top >= 720 OR bottom >= 720 THEN 'bottom' ELSE 'body' END AS zone FROM spans WHERE {tx.squeeze(T)} <> '')"
FURNITURE = "f AS MATERIALIZED (SELECT doc_id, zone, key, pages FROM (SELECT doc_id, zone, key, count(DISTINCT page) AS pages FROM z WHERE zone <> 'body' GROUP BY ALL) JOIN (SELECT doc_id, count(DISTINCT page) AS n_pages FROM z GROUP BY doc_id) USING (doc_id) WHERE n_pages >= 2 AND pages >= least(3, n_pages))"


def spans_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paras_of(spark, sf_dir)
    return rows.select("doc_id", "text", *[v.alias(k) for k, v in span_columns(F.col("pos"), F.col("font_size"), F.col("style_name")).items()])


@query(f"WITH {SPANS}, {FURNITURE} SELECT * FROM f")
def page_furniture_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.page_furniture_keys(spans_of(spark, sf_dir))


@query(f"""WITH {SPANS}, {FURNITURE}, s AS MATERIALIZED (SELECT z.*, f.key IS NOT NULL AS furniture, regexp_full_match({tx.squeeze(T)}, '\\d{{1,4}}|[ivxlcdmIVXLCDM]{{1,12}}') AND zone <> 'body' AS number, length(regexp_replace({tx.squeeze(T)}, '\\s+', '', 'g')) AS chars FROM z LEFT JOIN f USING (doc_id, zone, key)),
    z2 AS (SELECT doc_id, median(font_size) AS median_size, max(font_size) AS largest_size FROM s WHERE NOT furniture AND NOT number AND font_size > 0 GROUP BY doc_id),
    t AS (SELECT s.*, median_size, largest_size, NOT furniture AND NOT number AS body, {tx.size(tx.words(T))} AS w, {tx.matches(T, r'\p{L}')} AS letters, {tx.matches(T, r'\p{Lu}')} AS caps, {tx.like(tx.squeeze(T), r'^(?:[-*•●]|\d+[.)])\s+')} AS listed FROM s LEFT JOIN z2 USING (doc_id)),
    r AS (SELECT doc_id, count(DISTINCT page) AS pages, count(*) AS spans, sum(chars) AS visible, coalesce(sum(chars) FILTER (body), 0) AS body_chars, coalesce(sum(chars) FILTER (furniture), 0) AS furniture_chars, count(*) FILTER (body) AS body_spans,
      count(*) FILTER (NOT number AND w <= 14 AND (coalesce(font_size >= median_size * 1.18, FALSE) OR (is_bold AND ((letters > 0 AND caps * 100 >= letters * 55) OR w <= 8)))) AS headings, count(*) FILTER (listed) AS lists, count(*) FILTER (is_bold) AS bold, max(median_size) AS median_size, max(largest_size) AS largest_size FROM t GROUP BY doc_id),
    q3 AS (SELECT *, CASE WHEN visible = 0 THEN 0 ELSE round(body_chars::DOUBLE / visible, 4) END AS body_ratio, CASE WHEN visible = 0 THEN 0 ELSE round(furniture_chars::DOUBLE / visible, 4) END AS furniture_ratio, headings > 0 OR lists > 0 OR bold > 0 OR coalesce(largest_size > median_size, FALSE) AS structured FROM r),
    v AS (SELECT *, CASE WHEN visible = 0 OR body_spans = 0 THEN 'empty_text_layer' WHEN visible < 500 OR body_spans < 10 THEN 'too_little_text_layer' ELSE concat_ws(',', CASE WHEN visible < 1500 THEN 'low_visible_text_chars' END, CASE WHEN body_spans < 20 THEN 'low_body_span_count' END, CASE WHEN body_ratio < 0.7 THEN 'low_body_text_ratio' END, CASE WHEN furniture_ratio > 0.25 THEN 'high_page_furniture_ratio' END, CASE WHEN NOT structured THEN 'no_structure_signals' END) END AS reasons FROM q3)
    SELECT doc_id, pages, spans, visible, body_chars, body_ratio, furniture_ratio, body_spans, headings, lists, bold, CASE WHEN reasons IN ('empty_text_layer', 'too_little_text_layer') THEN 'scanned_or_unsupported' WHEN reasons = '' THEN 'promising' ELSE 'insufficient' END AS decision, reasons FROM v""")
def text_layer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.text_layer_report(spans_of(spark, sf_dir))


@query(r"""WITH h AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(replace(coalesce(text, ''), ' t', '-t')), '\p{L}+(?:-\p{L}+)*'))) AS word FROM documents), d AS (SELECT DISTINCT doc_id, replace(word, '-', '') AS word FROM h WHERE contains(word, '-'))
    SELECT h.doc_id, h.word FROM h WHERE NOT contains(word, '-') AND NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = h.doc_id AND d.word = h.word)""")
def hyphen_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit(" t"), F.lit("-t")).alias("text"))
    return st.hyphen_evidence(rows, "text")


# ---- retention, ledgers, reconciliation ----
@query("""WITH g AS (SELECT user_id, event_type, max(value) AS age, count(*) AS members FROM events GROUP BY user_id, event_type), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY age, event_type DESC) AS rank FROM g WHERE age <= 99.5) SELECT user_id, event_type, members, rank FROM r WHERE rank <= 2""")
def retained_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.retained_groups(table(spark, sf_dir, "events"), "user_id", "event_type", "value", 2, 99.5)


@query("""WITH live AS (SELECT DISTINCT user_id, event_id FROM events WHERE event_type = 'purchase'), x AS (SELECT e.* FROM events e WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.user_id = e.user_id AND l.event_id = e.event_id)),
    k AS (SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id DESC) AS rank FROM x WHERE value <= 50) WHERE rank <= 3) SELECT user_id, event_id FROM live UNION ALL SELECT * FROM k""")
def retained_with_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return sm.retained_protecting(events, events.where("event_type = 'purchase'").select("user_id", "event_id").distinct(), "user_id", "value", "event_id", 3, 50.0)


@query("""WITH u AS (SELECT user_id, event_type, CASE WHEN value >= 0 THEN value END AS cost, CASE WHEN event_id % 5 <> 0 THEN event_id % 97 END AS prompt, CASE WHEN event_id % 4 <> 0 THEN event_id % 89 END AS completion, CASE WHEN event_id % 3 = 0 THEN event_id % 1000 END AS total FROM events),
    v AS (SELECT *, prompt IS NOT NULL OR completion IS NOT NULL OR total IS NOT NULL AS reported, coalesce(total, coalesce(prompt, 0) + coalesce(completion, 0)) AS tokens FROM u)
    SELECT user_id, event_type, count(*) AS calls, sum(coalesce(prompt, 0)) AS prompt_tokens, sum(coalesce(completion, 0)) AS completion_tokens, sum(CASE WHEN reported THEN tokens ELSE 0 END) AS total_tokens, round(sum(coalesce(cost, 0)), 4) AS cost, count(*) FILTER (NOT reported) AS unreported, count(*) FILTER (NOT reported) = 0 AS complete
    FROM v GROUP BY GROUPING SETS ((user_id, event_type), (user_id))""")
def usage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    calls = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("value").alias("cost"), F.when(n % 5 != 0, n % 97).alias("prompt"), F.when(n % 4 != 0, n % 89).alias("completion"), F.when(n % 3 == 0, n % 1000).alias("total"))
    return sm.usage_ledger(calls, "user_id", "event_type")


@query(f"""WITH {FORMS}, want AS (SELECT doc_id, '[[DOCX_IMAGE_img_' || i || ']]' AS id FROM documents, range(0, 12) t(i)), have AS (SELECT doc_id, unnest({tx.found(T, tx.IMAGE)}) AS id FROM m), n AS (SELECT doc_id, id, count(*) AS n FROM have GROUP BY doc_id, id)
    SELECT coalesce(w.doc_id, n.doc_id) AS doc_id, coalesce(w.id, n.id) AS id, CASE WHEN w.id IS NULL THEN 'unexpected' WHEN n.n IS NULL THEN 'lost' WHEN n.n = 1 THEN 'ok' ELSE 'duplicated' END AS status FROM want w FULL JOIN n ON n.doc_id = w.doc_id AND n.id = w.id""")
def placeholder_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i")).select("doc_id", F.concat(F.lit("[[DOCX_IMAGE_img_"), F.col("i").cast("string"), F.lit("]]")).alias("id"))
    return sm.placeholder_integrity(expected, forms_of(spark, sf_dir), tx.IMAGE)


@query("""WITH s AS (SELECT conv_id, turn, role, length(coalesce(text, '')) AS n, lead(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn) AS m, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS other FROM conversations), j AS (SELECT role AS a, other AS b, CASE WHEN n = m THEN 'tie' WHEN n > m THEN role ELSE other END AS winner, abs(n - m) >= 200 AS decisive FROM s WHERE other IS NOT NULL),
    u AS (SELECT a AS candidate, winner, decisive FROM j UNION ALL SELECT b, winner, decisive FROM j) SELECT candidate, count(*) AS comparisons, sum(CASE WHEN winner = 'tie' THEN 0.5 WHEN winner = candidate THEN 1 ELSE 0 END)::DOUBLE AS credit, count(*) FILTER (winner = candidate AND decisive) AS decisive_wins,
    round(sum(CASE WHEN winner = 'tie' THEN 0.5 WHEN winner = candidate THEN 1 ELSE 0 END)::DOUBLE / count(*), 4) AS win_rate FROM u GROUP BY candidate""")
def pairwise_win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    n, turn = F.length(F.coalesce("text", F.lit(""))), Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("role", n.alias("n"), F.lead(n).over(turn).alias("m"), F.lead("role").over(turn).alias("other")).where("other IS NOT NULL")
    judged = rows.select(F.col("role").alias("left"), F.col("other").alias("right"), F.when(F.col("n") == F.col("m"), "tie").when(F.col("n") > F.col("m"), F.col("role")).otherwise(F.col("other")).alias("winner"), F.when(F.abs(F.col("n") - F.col("m")) >= 200, "decisive").otherwise("slight").alias("margin"))
    return sm.pairwise(judged)
