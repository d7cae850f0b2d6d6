"""Queries over the paragraph table: boundaries, cleanup, tiers, reports, relations, blocks, jobs and segments, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import boundary, layout
from folio.functions import fixed as fx
from folio.functions import text as tx
from folio.operators import jobs
from folio.operators import sequences as sq
from folio.operators import structure as su
from folio.registry import PARAS, T, c, named_sql, paras_of, query

# ---- boundaries ----
_EDGES = boundary.edges(*[c(x) for x in sq.PARAGRAPH])
_MADE = boundary.decide(lambda n: c(f"e.a_{n}"), lambda n: c(f"e.b_{n}"))
_NEXT = ", ".join(f"lead(a_{k}) OVER o AS b_{k}" for k in _EDGES)
PAIRS = f"""{PARAS}, ed AS MATERIALIZED (SELECT doc_id, pos, {', '.join(f'{v} AS a_{k}' for k, v in _EDGES.items())} FROM para),
e AS MATERIALIZED (SELECT *, {_NEXT}, lead(pos) OVER o AS next_pos FROM ed WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
d AS MATERIALIZED (SELECT doc_id, pos, {named_sql(_MADE)} FROM e WHERE next_pos IS NOT NULL)"""
_EFFECT = boundary.effective(c("decision"), c("confidence"), c("can_lead"), c("next_decision"))
EFFECTIVE = f"""{PAIRS}, nx AS (SELECT *, lead(decision) OVER (PARTITION BY doc_id ORDER BY pos) AS next_decision FROM d),
ef AS MATERIALIZED (SELECT doc_id, pos, {_EFFECT['decision']} AS decision, confidence, concat_ws(',', nullif(reasons, ''), nullif({_EFFECT['extra']}, '')) AS reasons FROM nx)"""


def _chains(decided: str) -> str:
    return f""", j AS (SELECT q.doc_id, q.pos, q.text, g.confidence AS merged FROM para q LEFT JOIN {decided} g ON g.doc_id = q.doc_id AND g.pos + 1 = q.pos AND g.decision = 'merge'),
k AS (SELECT *, sum(CASE WHEN merged IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS chain FROM j)
SELECT doc_id, min(pos) AS first_pos, count(*) AS n_rows, max(merged) AS confidence, {tx.joined_fragments(c("list(text ORDER BY pos)"))} AS text FROM k GROUP BY doc_id, chain"""


@query(f"WITH {PAIRS} SELECT doc_id, pos, decision, confidence, reasons FROM d")
def boundary_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.boundary_decisions(paras_of(spark, sf_dir)).drop("can_lead")


@query(f"WITH {EFFECTIVE} SELECT * FROM ef")
def boundary_high_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.effective_decisions(paras_of(spark, sf_dir))


@query(f"WITH {PAIRS} SELECT decision, confidence, count(*) AS n FROM d GROUP BY decision, confidence")
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.boundary_decisions(paras_of(spark, sf_dir)).groupBy("decision", "confidence").agg(F.count("pos").alias("n"))


@query(f"WITH {EFFECTIVE}{_chains('ef')}")
def merge_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.merge_chains(paras_of(spark, sf_dir))


@query(f"WITH {PAIRS}{_chains('d')}")
def merge_chains_medium(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.merge_chains(paras_of(spark, sf_dir), "high_and_medium")


@query(f"""WITH {PARAS}, b AS (SELECT doc_id, pos, {tx.strip(T)} AS t, role = 'body' AS is_body FROM para), l AS (SELECT *, lag(t) OVER o AS before, lag(is_body) OVER o AS was FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
    j AS (SELECT *, coalesce(was AND is_body AND t <> '' AND before <> '' AND NOT regexp_matches(before, '[\\d.!?…:;»”’\\x22\\x27)\\]}}]\\z') AND regexp_matches(t, '^\\p{{Ll}}'), FALSE) AS joins FROM l), u AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS unit FROM j)
    SELECT doc_id, min(pos) AS first_pos, count(*) AS n_rows FROM u GROUP BY doc_id, unit""")
def narration_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.narration_groups(paras_of(spark, sf_dir).select("doc_id", "pos", "text", "role"), F.col("role") == "body")


# ---- layout cleanup ----
def _cleanup(remove: bool, scanned: bool) -> str:
    x = [c(n) for n in ("text", "key", "role", "structural_role", "list_kind")]
    furniture = f"is_cadence AND {layout.page_cadence(c('cn'), c('n_rows'), c('cf'), c('cl'))}" if scanned else "FALSE"
    reason = layout.cleanup_reason(*x, c("layout_origin"), c("repeats"), c("is_title"), c("is_furniture"), c("is_candidate"))
    return f"""{PARAS}, y AS MATERIALIZED (SELECT *, {tx.layout_key(T)} AS key FROM para), ti AS MATERIALIZED (SELECT *, max(CASE WHEN pos < 12 AND key <> '' AND (role = 'heading' OR heading_level IS NOT NULL) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, key) = 1 AS is_title FROM y),
ca AS MATERIALIZED (SELECT *, {layout.repeat_candidate(*x, c('is_title'))} AS is_candidate, {layout.cadence_candidate(c('text'), c('key'), c('role'), c('list_kind'))} AS is_cadence, count(*) OVER (PARTITION BY doc_id) AS n_rows FROM ti),
re AS MATERIALIZED (SELECT *, greatest(sum(CASE WHEN is_candidate THEN 1 ELSE 0 END) OVER g, 1) AS repeats, count(CASE WHEN is_cadence THEN pos END) OVER g AS cn, min(CASE WHEN is_cadence THEN pos END) OVER g AS cf, max(CASE WHEN is_cadence THEN pos END) OVER g AS cl FROM ca WINDOW g AS (PARTITION BY doc_id, key)),
fu AS (SELECT *, {furniture} AS is_furniture FROM re), rs AS (SELECT *, {reason} AS reason FROM fu), ac AS MATERIALIZED (SELECT *, {layout.cleanup_action(c('reason'), remove)} AS action FROM rs)"""


CLEAN = f"SELECT doc_id, pos, action, reason, {layout.cleanup_confidence(c('reason'), c('action'))} AS confidence, repeats FROM ac"


@query(f"WITH {_cleanup(False, False)} {CLEAN}")
def layout_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return su.layout_cleanup(paras_of(spark, sf_dir))


@query(f"WITH {_cleanup(True, True)} {CLEAN}")
def layout_cleanup_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return su.layout_cleanup(paras_of(spark, sf_dir), remove=True, scanned=True)


@query(f"WITH {_cleanup(False, False)} SELECT action, reason, count(*) AS n FROM ac GROUP BY action, reason")
def layout_cleanup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return su.cleanup_counts(su.layout_cleanup(paras_of(spark, sf_dir)))


@query(f"WITH {_cleanup(True, True)} SELECT doc_id, key, max(cn) AS n, max(cf) AS first_pos, max(cl) AS last_pos FROM ac WHERE is_furniture GROUP BY doc_id, key")
def page_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return su.page_furniture(paras_of(spark, sf_dir))


# ---- tiers and clusters ----
@query(f"""WITH {PARAS}, z AS MATERIALIZED (SELECT *, CASE WHEN font_size > 0 THEN round(font_size, 1) END AS size FROM para), n AS (SELECT doc_id, size, count(*) AS n FROM z WHERE role NOT IN ('image', 'table') AND size IS NOT NULL GROUP BY doc_id, size),
    b AS (SELECT doc_id, first(size ORDER BY n DESC, size) AS base FROM n GROUP BY doc_id HAVING sum(n) >= 8), a AS (SELECT z.doc_id, z.size, count(*) AS n FROM z JOIN b USING (doc_id) WHERE font_size > base + 0.25 GROUP BY z.doc_id, z.size),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC) AS rank FROM a), t AS (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC) AS above_tier FROM r WHERE n >= 2 OR rank = 1),
    f AS (SELECT z.*, base, CASE WHEN base IS NULL OR z.size IS NULL THEN -1 WHEN abs(font_size - base) <= 0.25 THEN 0 WHEN font_size > base + 0.25 THEN coalesce(above_tier, -1) ELSE -1 END AS tier FROM z LEFT JOIN b USING (doc_id) LEFT JOIN t ON t.doc_id = z.doc_id AND t.size = z.size)
    SELECT doc_id, pos, tier, coalesce(tier > 0 AND size >= base * 1.15, FALSE) AS is_heading_tier, coalesce(lag(page) OVER (PARTITION BY doc_id ORDER BY pos) <> page, FALSE) AS first_on_page, length({tx.strip(T)}) <= 80 AS is_short FROM f""")
def layout_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return su.layout_tiers(paras_of(spark, sf_dir))


@query(f"""WITH {PARAS}, s AS (SELECT doc_id, pos, lower({tx.strip(c('style_name'))}) AS style FROM para), n AS (SELECT doc_id, style, count(*) AS n, min(pos) AS seen FROM s WHERE style <> '' GROUP BY doc_id, style), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, seen) AS rank FROM n),
    k AS (SELECT doc_id, style, row_number() OVER (PARTITION BY doc_id ORDER BY seen) AS cluster FROM r WHERE rank > 1) SELECT s.doc_id, s.pos, cluster FROM s LEFT JOIN k USING (doc_id, style)""")
def style_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return su.style_clusters(paras_of(spark, sf_dir))


# ---- report ----
_FLAGS = layout.risk_flags(*[c(n) for n in ("text", "role", "structural_role", "alignment", "list_kind")])
REGIONS = "tg AS (SELECT *, sum(CASE WHEN structural_role = 'toc_entry' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM para), tr AS MATERIALIZED (SELECT doc_id, min(pos) AS first_pos, count(*) FILTER (structural_role = 'toc_entry') AS n_entries FROM tg GROUP BY doc_id, run HAVING bool_or(structural_role = 'toc_header') AND count(*) FILTER (structural_role = 'toc_entry') >= 2)"


@query(f"WITH {PARAS}, {REGIONS} SELECT * FROM tr")
def toc_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.toc_regions(paras_of(spark, sf_dir))


def _longest(flag: str, value: str, test: str, name: str) -> str:
    return f"(SELECT doc_id, {value} AS {name} FROM (SELECT doc_id, i, count(*) AS n FROM (SELECT doc_id, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM fl WHERE {flag}) GROUP BY doc_id, i) WHERE {test} GROUP BY doc_id)"


@query(f"""WITH {PARAS}, {REGIONS}, fl AS MATERIALIZED (SELECT doc_id, pos, {', '.join(f'coalesce({v}, FALSE) AS {k}' for k, v in _FLAGS.items())} FROM para),
    ct AS (SELECT doc_id, count(*) AS n_rows, count(*) FILTER (filled) AS filled, count(*) FILTER (heading) AS headings, count(*) FILTER (short_body) AS short_body, count(*) FILTER (isolated) AS isolated, count(*) FILTER (toc_entry) AS toc_entries, count(*) FILTER (all_caps OR centered) AS caps_or_centered, coalesce(min(pos) FILTER (NOT front), count(*)) AS front_run FROM fl GROUP BY doc_id),
    al AS (SELECT ct.*, coalesce(toc_sequences, 0) AS toc_sequences, coalesce(longest_body, 0) AS longest_body, coalesce(toc_regions, 0) AS toc_regions FROM ct LEFT JOIN {_longest('toc_candidate', 'count(*)', 'n >= 4', 'toc_sequences')} USING (doc_id) LEFT JOIN {_longest('body_text', 'max(n)', 'TRUE', 'longest_body')} USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS toc_regions FROM tr GROUP BY doc_id) USING (doc_id)),
    rs AS (SELECT *, {tx.reasons(*layout.escalation(c))} AS reasons FROM al), rk AS (SELECT *, {layout.risk_level(c('reasons'))} AS risk FROM rs) SELECT *, {layout.readiness(c, c('risk'))} AS readiness FROM rk""")
def structure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return su.structure_report(paras_of(spark, sf_dir))


# ---- relations ----
QUOTES, TOCS = (", ".join(f"'{r}'" for r in x) for x in (fx.QUOTE_ROLES, fx.TOC_ROLES))
RELATIONS = f"""{PARAS}, nb AS MATERIALIZED (SELECT *, lag(role) OVER o AS before, lag(asset_id) OVER o AS before_asset, lead(role) OVER o AS next_role, lead(structural_role) OVER o AS next_kind, lead(text) OVER o AS next_text FROM para WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
 cp AS (SELECT *, coalesce(before IN ('image', 'table'), FALSE) AS asset FROM nb), cr AS (SELECT *, CASE WHEN before IS NULL THEN 'caption_without_preceding_asset' WHEN NOT asset THEN 'caption_not_adjacent_to_asset' WHEN before_asset IS NULL THEN 'missing_caption_anchor_identity' END AS refused FROM cp WHERE role = 'caption' OR (asset AND role <> 'heading' AND {tx.is_caption(T)})),
 qt AS (SELECT *, structural_role = 'epigraph' AS ep, next_kind = 'attribution' AS said, role NOT IN ('image', 'table', 'caption', 'list') AND next_role NOT IN ('image', 'table', 'caption', 'list') AS plain, {tx.is_attribution(c('next_text'))} AS att FROM nb WHERE next_role IS NOT NULL),
 qr AS (SELECT *, plain AND ((ep AND said) OR (ep AND att) OR (said AND coalesce(alignment = 'center', FALSE))) AS pair, CASE WHEN ep AND NOT said THEN 'epigraph_without_attribution' WHEN said AND NOT ep THEN 'attribution_without_epigraph' WHEN ep AND att THEN 'epigraph_candidate_rejected' END AS why FROM qt),
 tb AS (SELECT *, CASE WHEN lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) = pos - 1 AND structural_role = 'toc_entry' THEN 0 ELSE 1 END AS brk FROM para WHERE structural_role IN ({TOCS})), tc AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM tb),
 tt AS (SELECT doc_id, min(pos) AS first_pos, count(*) AS n, bool_or(structural_role = 'toc_header') AS headed FROM tc GROUP BY doc_id, grp),
 ev AS (SELECT doc_id, CASE WHEN asset THEN before || '_caption' ELSE 'caption_attachment' END AS kind, CASE WHEN refused IS NULL THEN 'accept' ELSE 'reject' END AS decision, coalesce(refused, 'adjacent_asset_caption') AS reason, CASE WHEN refused IS NULL OR asset THEN pos - 1 ELSE pos END AS first_pos, CASE WHEN refused IS NULL OR asset THEN 2 ELSE 1 END AS n_members, 1 AS pass FROM cr
   UNION ALL SELECT doc_id, 'epigraph_attribution', CASE WHEN pair THEN 'accept' ELSE 'reject' END, CASE WHEN pair THEN 'adjacent_epigraph_attribution' ELSE why END, pos, 2, 2 FROM qr WHERE pair OR why IS NOT NULL
   UNION ALL SELECT doc_id, 'toc_region', CASE WHEN n >= 2 THEN 'accept' ELSE 'reject' END, CASE WHEN n >= 2 AND headed THEN 'toc_header_with_entries' WHEN n >= 2 THEN 'contiguous_toc_entries' WHEN headed THEN 'toc_header_without_entries' ELSE 'isolated_toc_entry' END, first_pos, n, 3 FROM tt),
 rl AS MATERIALIZED (SELECT doc_id, kind, decision, reason, first_pos, n_members, CASE WHEN decision = 'accept' THEN 'rel_' || lpad((sum(CASE WHEN decision = 'accept' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pass, first_pos))::VARCHAR, 4, '0') END AS relation_id FROM ev)"""


@query(f"WITH {RELATIONS} SELECT * FROM rl")
def paragraph_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return su.relations(paras_of(spark, sf_dir))


@query(f"WITH {RELATIONS} SELECT q.doc_id, q.pos, a.asset_id AS attached_to FROM para q LEFT JOIN (SELECT doc_id, first_pos FROM rl WHERE decision = 'accept' AND kind IN ('image_caption', 'table_caption')) r ON r.doc_id = q.doc_id AND r.first_pos + 1 = q.pos LEFT JOIN para a ON a.doc_id = r.doc_id AND a.pos = r.first_pos WHERE q.role = 'caption'")
def attached_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paras_of(spark, sf_dir)
    return su.attached_assets(rows, su.relations(rows))


# ---- units, blocks, jobs ----
_RENDERED = tx.rendered(T, c("role"), c("structural_role"), c("heading_level"), c("list_kind"), c("0"))
UNITS = f"""{RELATIONS}, sp AS (SELECT DISTINCT doc_id, unnest(range(first_pos + 1, first_pos + n_members)) AS pos FROM rl WHERE decision = 'accept'),
 un AS MATERIALIZED (SELECT q.*, {_RENDERED} AS rendered, sum(CASE WHEN related OR alike THEN 0 ELSE 1 END) OVER (PARTITION BY q.doc_id ORDER BY q.pos) AS unit FROM (SELECT para.*, sp.pos IS NOT NULL AS related, coalesce((structural_role IN ({QUOTES}) AND lag(structural_role) OVER o IN ({QUOTES})) OR (structural_role IN ({TOCS}) AND lag(structural_role) OVER o IN ({TOCS})), FALSE) AS alike FROM para LEFT JOIN sp ON sp.doc_id = para.doc_id AND sp.pos = para.pos WINDOW o AS (PARTITION BY para.doc_id ORDER BY para.pos)) q)"""


@query(f"WITH {UNITS} SELECT doc_id, pos, unit FROM un")
def block_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paras_of(spark, sf_dir)
    return jobs.units(rows, su.relations(rows)).select("doc_id", "pos", "unit")


SOFT = max(1200, min(6000, int(6000 * 0.7)))
_FITS = f"""CASE WHEN w.atomic OR u.atomic OR u.toc <> w.toc THEN FALSE WHEN u.headings OR w.headings THEN w.headings WHEN w.last = 'heading' AND (u.quotes OR u.captions) THEN TRUE WHEN w.lists AND u.lists THEN w.size + 2 + u.size <= 6000 OR w.size < {SOFT}
    WHEN w.lists AND (w.size >= {max(600, SOFT // 2)} OR w.n > 1) THEN FALSE ELSE w.size + 2 + u.size <= 6000 AND (w.size < {SOFT} OR (u.size <= 1500 AND w.size < 5400)) END"""
PACKED = f"""{UNITS}, u AS MATERIALIZED (SELECT doc_id, unit, min(pos) AS first_pos, count(*) AS n, sum(length(rendered)) + 2 * (count(*) - 1) AS size, bool_or(role IN ('image', 'table')) AS atomic, bool_and(role = 'heading') AS headings, bool_and(role = 'list') AS lists, bool_and(role = 'caption') AS captions, bool_and(structural_role IN ({QUOTES})) AS quotes, bool_and(structural_role IN ({TOCS})) AS toc, arg_max(role, pos) AS last FROM un GROUP BY doc_id, unit),
 w AS (SELECT doc_id, unit, 0 AS block, size, n, atomic, headings, lists, toc, last FROM u WHERE unit = 1
   UNION ALL SELECT u.doc_id, u.unit, CASE WHEN {_FITS} THEN w.block ELSE w.block + 1 END, CASE WHEN {_FITS} THEN w.size + 2 + u.size ELSE u.size END, CASE WHEN {_FITS} THEN w.n + u.n ELSE u.n END, CASE WHEN {_FITS} THEN w.atomic OR u.atomic ELSE u.atomic END,
     CASE WHEN {_FITS} THEN w.headings AND u.headings ELSE u.headings END, CASE WHEN {_FITS} THEN w.lists AND u.lists ELSE u.lists END, CASE WHEN {_FITS} THEN w.toc AND u.toc ELSE u.toc END, u.last FROM w JOIN u ON u.doc_id = w.doc_id AND u.unit = w.unit + 1)"""
BLOCKS = f"{PACKED}, bl AS MATERIALIZED (SELECT un.doc_id, w.block, min(un.pos) AS first_pos, count(*) AS paragraph_count, count(*) FILTER (structural_role IN ({TOCS})) AS toc_count, count(*) FILTER (role = 'image') AS images, string_agg(rendered, chr(10) || chr(10) ORDER BY un.pos) AS target_text FROM un JOIN w ON w.doc_id = un.doc_id AND w.unit = un.unit GROUP BY un.doc_id, w.block)"


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = paras_of(spark, sf_dir)
    return rows, su.relations(rows)


@query(f"WITH RECURSIVE {PACKED} SELECT doc_id, unit, block FROM w")
def semantic_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.semantic_blocks(*_found(spark, sf_dir))


@query(f"WITH RECURSIVE {BLOCKS} SELECT doc_id, block, first_pos, paragraph_count, toc_count, images, sha256(target_text) AS text_sha FROM bl")
def block_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.block_texts(*_found(spark, sf_dir)).withColumn("text_sha", F.sha2(F.col("target_text").cast("binary"), 256)).drop("target_text")


def _context(limit: int, order: str) -> str:
    total = f"sum(CASE WHEN own > 0 THEN own + 2 END) OVER (PARTITION BY doc_id ORDER BY block {order} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    return f"greatest(least(coalesce({total} - 2, 0), {limit}), 0)"


@query(f"""WITH RECURSIVE {BLOCKS}, ow AS (SELECT *, length({tx.strip(c('target_text'))}) AS own FROM bl)
    SELECT doc_id, block, CASE WHEN images = paragraph_count OR toc_count = paragraph_count THEN 'passthrough' ELSE 'llm' END AS job_kind, paragraph_count, toc_count, toc_count * 10 >= paragraph_count * 7 AS toc_dominant, length(target_text) AS target_chars, {_context(1200, 'DESC')} AS before_chars, {_context(720, 'ASC')} AS after_chars FROM ow""")
def editing_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.editing_jobs(*_found(spark, sf_dir))


# ---- segments: a budget of 250 characters a chunk would never split these documents, so none of the parts' rules would be seen ----
_STARTS = f"role = 'heading' AND structural_role NOT IN ('toc_header', 'toc_entry', 'caption', 'image', 'table') AND {tx.strip(T)} <> ''"
SEGMENTS = f"""{PARAS}, sg AS (SELECT doc_id, pos, text, heading_level, {_STARTS} AS starts, length(text) AS n, {tx.size(tx.words(T))} AS n_words FROM para), hd AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS head FROM sg),
 lg AS MATERIALIZED (SELECT *, sum(n) OVER g > 24000 AND count(*) OVER g > 1 AS long FROM hd WINDOW g AS (PARTITION BY doc_id, head)),
 cu AS (SELECT doc_id, pos, head, 0 AS part, CASE WHEN long AND starts THEN -1 ELSE n END AS size FROM lg WHERE pos = 0
   UNION ALL SELECT l.doc_id, l.pos, l.head, CASE WHEN l.head <> w.head THEN 0 WHEN l.long AND (w.size < 0 OR w.size >= 24000) THEN w.part + 1 ELSE w.part END, CASE WHEN l.head <> w.head THEN CASE WHEN l.long AND l.starts THEN -1 ELSE l.n END WHEN l.long AND (w.size < 0 OR w.size >= 24000) THEN l.n ELSE w.size + l.n END FROM cu w JOIN lg l ON l.doc_id = w.doc_id AND l.pos = w.pos + 1),
 ag AS (SELECT lg.doc_id, lg.head, part, min(lg.pos) AS first_pos, max(lg.pos) AS last_pos, arg_min(coalesce(heading_level, {tx.likely_level(T)}), lg.pos) AS own_level, arg_min(text, lg.pos) AS title, bool_or(long) AS long, count(*) AS paragraphs, sum(n) AS chars, sum(n_words) AS words FROM lg JOIN cu ON cu.doc_id = lg.doc_id AND cu.pos = lg.pos GROUP BY lg.doc_id, lg.head, part),
 lv AS (SELECT *, first(own_level) OVER o AS top, first(title) OVER o AS opening FROM ag WINDOW o AS (PARTITION BY doc_id, head ORDER BY part)), le AS (SELECT *, CASE WHEN head = 0 THEN 1 WHEN part > 0 THEN least(top + 1, 6) ELSE top END AS level FROM lv),
 seg AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_pos) AS ordinal, first_pos, last_pos, level, CASE WHEN head = 0 THEN CASE WHEN long THEN 'body_range' ELSE 'front_matter' END ELSE {tx.heading_role(c('opening'), c('(level - CASE WHEN part > 0 THEN 1 ELSE 0 END)'))} END AS role,
   CASE WHEN part > 0 OR (head = 0 AND long) THEN 'low' WHEN head = 0 THEN 'medium' ELSE 'high' END AS confidence, paragraphs, chars, words, greatest(1, chars // 4) AS tokens FROM le)"""


@query(f"WITH RECURSIVE {SEGMENTS} SELECT * FROM seg")
def document_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.segments(paras_of(spark, sf_dir))


@query(f"WITH RECURSIVE {SEGMENTS} SELECT a.doc_id, a.ordinal, max(b.ordinal) AS parent FROM seg a LEFT JOIN seg b ON b.doc_id = a.doc_id AND b.ordinal < a.ordinal AND b.level < a.level GROUP BY a.doc_id, a.ordinal")
def segment_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.parents(jobs.segments(paras_of(spark, sf_dir)))


@query(f"WITH RECURSIVE {SEGMENTS} SELECT doc_id, ordinal, 'seg_' || lpad(ordinal::VARCHAR, 4, '0') || '_' || substr(sha1(concat_ws('|', doc_id, role, level, first_pos, last_pos, 'chapter_segments_v1')), 1, 8) AS segment_id FROM seg")
def segment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.segment_ids(jobs.segments(paras_of(spark, sf_dir)))


@query(f"WITH RECURSIVE {BLOCKS}, {SEGMENTS.removeprefix(PARAS + ', ')} SELECT b.doc_id, b.block, s.ordinal FROM bl b LEFT JOIN seg s ON s.doc_id = b.doc_id AND b.first_pos >= s.first_pos AND b.first_pos + b.paragraph_count - 1 <= s.last_pos")
def segment_of_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = _found(spark, sf_dir)
    return jobs.segment_of_blocks(jobs.segments(rows), jobs.block_texts(rows, found))
