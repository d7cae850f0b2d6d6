"""Queries of detectors, small rules over numbers and identities, published tables and event state, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import fixed as fx
from folio.functions import text as tx
from folio.functions.core import plus, text_of
from folio.operators import detectors as de
from folio.operators.sequences import by_place
from folio.registry import FORMS, LINES, PARAS, T, c, forms_of, lines_of, paras_of, query
from folio.session import new_folder
from folio.sources.tables import table
from folio.streaming import progress as sp

O = "WINDOW o AS (PARTITION BY doc_id ORDER BY pos)"  # noqa: E741


# ---- detectors: fences and words of both scripts are put into the forms by place ----
def fenced(t, n, doc):
    return tx.case(((doc + n) % 13 == 5, "```"), ((doc + n) % 7 == 2, plus(t, " домoв мiр and https://a.b/сa")), other=t)


FENCED = f"{FORMS}, fx AS MATERIALIZED (SELECT doc_id, pos, {fenced(T, c('pos'), c('doc_id'))} AS text FROM m), fe AS (SELECT *, {tx.like(T, r'^\s*(?:`{3,}|~{3,})')} AS fence, sum(CASE WHEN {tx.like(T, r'^\s*(?:`{3,}|~{3,})')} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS fences FROM fx), fo AS MATERIALIZED (SELECT doc_id, pos, text FROM fe WHERE NOT fence AND fences % 2 = 0)"


def fenced_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms_of(spark, sf_dir).select("doc_id", "pos", fenced(F.col("text"), F.col("pos"), F.col("doc_id")).alias("text"))


@query(f"WITH {FENCED} SELECT * FROM fo")
def lines_outside_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.outside_fences(fenced_of(spark, sf_dir))


@query(f"""WITH {FENCED}, w AS (SELECT doc_id, pos, unnest({tx.words(c("regexp_replace(text, '`[^`]+`', ' ', 'g')"))}) AS word FROM fo), k AS (SELECT doc_id, pos, unnest(regexp_extract_all(word, '[A-Za-zА-Яа-яЁё]+')) AS token FROM w WHERE NOT regexp_matches(word, '://|www\\.|@|[\\p{{L}}\\p{{N}}_-]+\\.[\\p{{L}}\\p{{N}}_-]{{2,}}'))
    SELECT DISTINCT doc_id, pos, token FROM k WHERE regexp_matches(token, '[A-Za-z]') AND regexp_matches(token, '[А-Яа-яЁё]')""")
def mixed_script_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.mixed_script_words(fenced_of(spark, sf_dir))


@query(f"""WITH {FORMS}, a AS (SELECT doc_id, pos, {tx.strip(T)} AS t, {tx.strip(c("coalesce(lead(text) OVER (PARTITION BY doc_id ORDER BY pos), '')"))} AS after FROM m), b AS (SELECT *, {tx.strip(c('substr(after, 3)'))} AS rest FROM a WHERE t <> ''),
    k AS (SELECT *, starts_with(t, '- ') AS item, starts_with(after, '- ') AS next_item, regexp_matches(rest, '^[a-zа-яё]') AS low, {tx.size(tx.words(c('rest')))} AS n, regexp_matches(t, '(?:^|\\s)\\d+\\.\\z') AS num, NOT (starts_with(t, '- ') OR starts_with(t, '#') OR starts_with(t, '>')) AS plain FROM b),
    r AS (SELECT doc_id, pos, CASE WHEN item AND num THEN 'dangling_number' WHEN item AND next_item AND rest <> '' AND (low OR n <= 3) THEN 'item_goes_on' WHEN plain AND next_item AND rest <> '' AND NOT regexp_matches(t, '[.!?…:](?:[)\\]»”’\\x27\\x22])?\\z') AND (low OR n <= 4) THEN 'prose_goes_on_as_item' WHEN plain AND num THEN 'dangling_number_in_prose' END AS reason FROM k) SELECT * FROM r WHERE reason IS NOT NULL""")
def list_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.list_fragments(forms_of(spark, sf_dir))


NUMBER = r"(?:^|[^\p{L}\p{N}_:])((?:page\s+)?(?:\d{1,4}|[ivxlcdm]{1,8}))(?:[^\p{L}\p{N}_:]|\z)"


# Lines with their place in front, like headers of pages.
@query(f"""WITH {LINES}, n AS (SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN 'The Running Title ' || (pos + 10) || ' part' ELSE text END AS text FROM p), f AS (SELECT doc_id, lower({tx.strip(T)}) AS s FROM n WHERE {tx.strip(T)} <> '' AND NOT starts_with({tx.strip(T)}, '>') AND NOT regexp_matches({tx.strip(T)}, '^#{{1,6}}\\s+') AND NOT regexp_matches(text, '\\.{{2,}}\\s*\\d{{1,4}}\\s*\\z')),
    k AS (SELECT *, {tx.group(c('s'), NUMBER, 1)} AS token FROM f), h AS (SELECT doc_id, unnest([{tx.running_header(c("substr(s, 1, strpos(s, token) - 1)"))}, {tx.running_header(c("substr(s, strpos(s, token) + length(token))"))}]) AS header FROM k WHERE token <> '') SELECT doc_id, header, count(*) AS n FROM h WHERE header IS NOT NULL GROUP BY doc_id, header HAVING count(*) >= 3""")
def repeated_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("The Running Title "), (F.col("pos") + 10).cast("string"), F.lit(" part"))).otherwise(F.col("text"))
    return de.repeated_headers(lines_of(spark, sf_dir).select("doc_id", "pos", header.alias("text")))


_TITLE = tx.group(c("t"), r"^#{1,6}\s+(.*)\z", 1)
DEFECTS = f"""{FENCED}, dl AS (SELECT doc_id, pos, {tx.strip(T)} AS t FROM fo), dt AS (SELECT *, {_TITLE} AS title, {tx.heading_level(c('t'))} AS level FROM dl WHERE t <> ''), dn AS (SELECT *, lead(level) OVER (PARTITION BY doc_id ORDER BY pos) AS next_level FROM dt),
 de AS MATERIALIZED (SELECT doc_id, pos, unnest({tx.named(("adjacent_h1_without_body", c("coalesce(level = 1 AND next_level = 1, FALSE)")), ("heading_body_concat_detected", c(f"coalesce(level IS NOT NULL AND {tx.is_heading_body_concat(c('title'))}, FALSE)")), ("h1_epigraph_attribution_pattern", c(f"coalesce(level = 1 AND {tx.is_epigraph_heading(c('title'), None)}, FALSE)")), ("pdf_blank_page_marker_leakage", c(f"(level IS NULL AND NOT starts_with(t, '>') AND {tx.like(tx.furniture_hits(c('t')), 'blank')})")))}) AS detector FROM dn)"""


@query(f"WITH {DEFECTS} SELECT * FROM de")
def heading_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.heading_defects(fenced_of(spark, sf_dir))


@query(f"WITH {DEFECTS}, n AS (SELECT detector, count(*) AS n FROM de GROUP BY detector), f AS (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY doc_id, pos) AS nth FROM de) SELECT detector, n, nth, doc_id, pos FROM f JOIN n USING (detector) WHERE nth <= 5")
def detector_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.detector_summary(de.heading_defects(fenced_of(spark, sf_dir)))


# Every fourth line takes in the line behind it.
_TOK = "' ' || array_to_string({0}, ' ') || ' '"


@query(f"""WITH {LINES}, l AS (SELECT doc_id, pos, text AS source, CASE WHEN pos % 4 = 1 THEN text || ' ' || coalesce(lead(text) OVER (PARTITION BY doc_id ORDER BY pos), '') ELSE text END AS text FROM p), t AS (SELECT doc_id, pos, {tx.tokens(T)} AS t, ' ' || coalesce(array_to_string({tx.tokens(c('source'))}, ' '), '') || ' ' AS s FROM l),
    n AS (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY pos) AS before, lead(s) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM t), h AS (SELECT doc_id, pos, list_filter(list_transform(range(1, len(t) - 4), lambda i: ' ' || array_to_string(t[i:i + 5], ' ') || ' '), lambda x: NOT contains(s, x) AND (coalesce(contains(before, x), FALSE) OR coalesce(contains(after, x), FALSE)))[1] AS leaked FROM n WHERE len(t) >= 6) SELECT doc_id, pos, trim(leaked) AS leaked FROM h WHERE leaked IS NOT NULL""")
def context_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = F.when(F.col("pos") % 4 == 1, F.concat("text", F.lit(" "), F.coalesce(F.lead("text").over(by_place()), F.lit("")))).otherwise(F.col("text"))
    return de.context_leaks(lines_of(spark, sf_dir).select("doc_id", "pos", F.col("text").alias("source"), taken.alias("text")))


@query(f"""WITH {FORMS}, t AS (SELECT doc_id, pos, {tx.strip(T)} AS t FROM m), n AS (SELECT *, list_filter([lag(t, 1) OVER o, lead(t, 1) OVER o, lag(t, 2) OVER o, lead(t, 2) OVER o, lag(t, 3) OVER o, lead(t, 3) OVER o], lambda x: x IS NOT NULL) AS near FROM t {O}), h AS (SELECT *, len(list_filter(near, lambda x: contains(x, t))) AS hits, length(regexp_replace(t, '\\s+', '', 'g')) AS solid FROM n)
    SELECT doc_id, pos, CASE WHEN solid < 24 THEN 'duplicate_fragment_too_short' WHEN hits > 1 THEN 'duplicate_fragment_ambiguous_neighbor_match' WHEN hits = 0 THEN 'duplicate_fragment_unique_continuation' ELSE 'duplicate' END AS verdict FROM h""")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.near_duplicates(forms_of(spark, sf_dir))


# ---- places within a book ----
_S = tx.strip(T)


@query(f"""WITH {PARAS}, f AS (SELECT doc_id, pos, font_size, {tx.matches(_S, r'\p{L}')} AS l, length({_S}) AS n FROM para WHERE pos < 12 AND role NOT IN ('image', 'table', 'caption', 'list') AND structural_role NOT IN ('toc_header', 'toc_entry') AND length({_S}) <= 180 AND {tx.matches(_S, r'\p{L}')} >= 8 AND font_size >= 18 AND NOT {tx.like(_S, r'[.;!?]\z')})
    SELECT doc_id, first(pos ORDER BY font_size DESC, l DESC, n DESC, pos) AS pos FROM f GROUP BY doc_id""")
def display_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.display_title(paras_of(spark, sf_dir))


@query(f"WITH {PARAS} SELECT doc_id, pos, CASE WHEN coalesce(lag(role) OVER o IN ('image', 'table'), FALSE) AND role <> 'heading' AND {tx.is_caption(T)} THEN 'caption' ELSE role END AS role FROM para {O}")
def adjacent_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.adjacent_captions(paras_of(spark, sf_dir))


FRONT = f"fr AS (SELECT doc_id, pos, role, {tx.squeeze(T)} AS s FROM para), fq AS (SELECT *, sum(CASE WHEN role = 'body' AND length(s) >= 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS run FROM fr), fb AS MATERIALIZED (SELECT doc_id, coalesce(min(pos) FILTER (role = 'heading' AND {tx.like(tx.lower(c('s')), fx.CHAPTER_BODY)}), min(pos) FILTER (run = 3)) AS boundary FROM fq GROUP BY doc_id)"
BACK = f"bk AS MATERIALIZED (SELECT para.doc_id, min(pos) AS start FROM para JOIN fb USING (doc_id) WHERE {tx.lower(tx.squeeze(T)).isin(*fx.BACK_MATTER)} AND pos > coalesce(boundary, -1) GROUP BY para.doc_id)"


@query(f"WITH {PARAS}, {FRONT} SELECT * FROM fb")
def front_matter_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.front_matter_end(paras_of(spark, sf_dir))


@query(f"WITH {PARAS}, {FRONT}, {BACK} SELECT * FROM bk")
def back_matter_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paras_of(spark, sf_dir)
    return de.back_matter_start(rows, de.front_matter_end(rows))


PASSING = f"{PARAS}, {FRONT}, {BACK}, ps AS MATERIALIZED (SELECT para.doc_id, pos, coalesce({tx.passthrough_form(T, c('role'), c('structural_role'))}, CASE WHEN pos < boundary THEN 'front_matter' END, CASE WHEN coalesce(pos >= start, FALSE) AND {tx.is_index_row(T)} THEN 'index' END, CASE WHEN coalesce(pos >= start, FALSE) AND NOT {tx.is_body_prose(T)} THEN 'references' END, 'retained') AS category FROM para LEFT JOIN fb ON fb.doc_id = para.doc_id LEFT JOIN bk ON bk.doc_id = para.doc_id)"


def _passing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paras_of(spark, sf_dir)
    ends = de.front_matter_end(rows)
    return de.passthrough(rows, ends, de.back_matter_start(rows, ends))


@query(f"WITH {PASSING} SELECT * FROM ps")
def passthrough_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passing(spark, sf_dir)


@query(f"WITH {PASSING} SELECT doc_id, category, count(*) AS n FROM ps GROUP BY doc_id, category")
def passthrough_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passing(spark, sf_dir).groupBy("doc_id", "category").agg(F.count("pos").alias("n"))


_BOLD, _ITALIC = de.emphasis(T)


@query(f"WITH {FORMS}, e AS (SELECT doc_id, {_BOLD} AS b, {_ITALIC} AS i FROM m) SELECT doc_id, sum(b) AS bold, sum(i) AS italic, CASE WHEN sum(b) > 0 THEN round(sum(i)::DOUBLE / sum(b), 4) END AS retention FROM e GROUP BY doc_id")
def emphasis_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bold, italic = de.emphasis(F.col("text"))
    out = forms_of(spark, sf_dir).groupBy("doc_id").agg(F.sum(bold).alias("bold"), F.sum(italic).alias("italic"))
    return out.withColumn("retention", F.when(F.col("bold") > 0, F.round(F.col("italic") / F.col("bold"), 4)))


@query(f"""WITH {PARAS}, k AS (SELECT doc_id, pos, {tx.layout_key(T)} AS key FROM para WHERE pos < 12 AND (role = 'heading' OR heading_level IS NOT NULL)) SELECT DISTINCT doc_id, key FROM k WHERE key <> ''""")
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paras_of(spark, sf_dir).where("pos < 12 AND (role = 'heading' OR heading_level IS NOT NULL)")
    return rows.select("doc_id", tx.layout_key(F.col("text")).alias("key")).where("key <> ''").distinct()


# ---- identities and numbers ----
_UNIT = f"""'{{"canonical_text": ' || to_json({tx.strip(T)}) || ', "logical_indexes": [' || pos || '], "unit_type": "paragraph"}}'"""


@query(f"WITH {LINES} SELECT doc_id, pos, 'u_' || substr(sha1({_UNIT}), 1, 12) AS unit_id FROM p")
def unit_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id from what a unit is: hash of its JSON with sorted keys."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(tx.strip(F.col("text")), r"\\", r"\\\\"), '"', r'\\"'), "\t", r"\\t")
    json = F.concat(F.lit('{"canonical_text": "'), text, F.lit('", "logical_indexes": ['), F.col("pos").cast("string"), F.lit('], "unit_type": "paragraph"}'))
    return lines_of(spark, sf_dir).select("doc_id", "pos", F.concat(F.lit("u_"), F.substring(F.sha1(json.cast("binary")), 1, 12)).alias("unit_id"))


@query("SELECT event_id, round_even(value * 2, 0) / 2 AS gap FROM events WHERE value IS NOT NULL")
def rounded_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves of a point, half to even."""
    return table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", (F.bround(F.col("value") * 2) / 2).alias("gap"))


FLAGS = "['1', 'true', ' YES ', 'on', '0', 'false', 'No', 'off', 'maybe', ''][(event_id % 10 + 1)::INTEGER]"


@query(f"SELECT event_id, {tx.coerced_flag(c(FLAGS))} AS flag, {text_of(tx.paragraph_words(c('event_id')))} AS plural FROM events")
def coerced_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*[F.lit(x) for x in ("1", "true", " YES ", "on", "0", "false", "No", "off", "maybe", "")])
    return table(spark, sf_dir, "events").select("event_id", tx.coerced_flag(F.get(words, (F.col("event_id") % 10).cast("int"))).alias("flag"), tx.paragraph_words(F.col("event_id")).alias("plural"))


_START, _END = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|\z)"
TERMS = {"passage": r"pass[a-z]+", "the": rf"{_START}the[a-z]*", "und": rf"{_START}und{_END}", "est": rf"{_START}est[a-z]+{_END}"}


@query("WITH x AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS term, len(regexp_extract_all(t, '{p}')) AS hits FROM x WHERE regexp_matches(t, '{p}')" for k, p in TERMS.items()))
def terminology_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which terms of a glossary a text uses: one pass over each text with all patterns, as many as the glossary has."""
    t = F.lower(F.coalesce("text", F.lit("")))
    hits = F.explode(F.array(*[F.struct(F.lit(k).alias("term"), tx.matches(t, p).alias("hits")) for k, p in TERMS.items()])).alias("x")
    return table(spark, sf_dir, "documents").select("doc_id", hits).select("doc_id", "x.term", "x.hits").where("hits > 0")


MAGIC = "CASE doc_id % 5 WHEN 0 THEN 'PK' || chr(3) || chr(4) WHEN 1 THEN '%PDF-1.7' WHEN 2 THEN 'D0CF11E0' ELSE '' END || coalesce(text, '')"
NAME = "'file_' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.docx' WHEN 1 THEN '.doc' WHEN 2 THEN '.PDF' ELSE '.bin' END"


def upload_format(name, head):
    """Format of a file by its first characters, else by its suffix; an old office container is doc only by its name."""
    suffix = tx.lower(tx.group(name, r"(\.[A-Za-z]+)\z", 1))
    return tx.case((tx.starts(head, "PK\x03\x04"), "docx"), (tx.starts(head, "D0CF11E0") & (suffix == ".doc"), "doc"), (tx.starts(head, "D0CF11E0"), "unknown"), (tx.starts(head, "%PDF"), "pdf"), (suffix.isin(".docx", ".doc", ".pdf"), tx.sub(suffix, r"^\.", "")), other="unknown")


@query(f"WITH f AS (SELECT doc_id, {NAME} AS name, {MAGIC} AS head FROM documents) SELECT doc_id, {upload_format(c('name'), c('head'))} AS format, name || ':' || length(head) || ':' || substr(sha256(head), 1, 16) AS token FROM f")
def upload_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    head = F.concat(F.when(d % 5 == 0, "PK\x03\x04").when(d % 5 == 1, "%PDF-1.7").when(d % 5 == 2, "D0CF11E0").otherwise(""), F.coalesce("text", F.lit("")))
    name = F.concat(F.lit("file_"), d.cast("string"), F.when(d % 4 == 0, ".docx").when(d % 4 == 1, ".doc").when(d % 4 == 2, ".PDF").otherwise(".bin"))
    rows = table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), head.alias("head"))
    return rows.select("doc_id", upload_format(F.col("name"), F.col("head")).alias("format"), F.concat_ws(":", "name", F.length("head").cast("string"), tx.short_hash(F.col("head"))).alias("token"))


# ---- published tables: written, read back, the newest record of each key ----
@query(f"WITH {PARAS}, k AS (SELECT doc_id, role, count(*) AS n, min(pos) AS first_pos FROM para GROUP BY doc_id, role) SELECT doc_id, role, n, first_pos FROM k")
def published_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry published by role, as one partition each, and what a reader of the folder gets."""
    rows = paras_of(spark, sf_dir).groupBy("doc_id", "role").agg(F.count("pos").alias("n"), F.min("pos").alias("first_pos"))
    folder = new_folder(spark, "registry")
    # One shuffle by the partition column and a bounded hash of the key: a common role is several files, not one task's.
    rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64))).repartition("role", "part").drop("part").write.partitionBy("role").parquet(folder)
    return spark.read.schema("doc_id long, n long, first_pos int, role string").parquet(folder)


@query(f"""WITH {PARAS}, k AS (SELECT doc_id, role, count(*) AS n FROM para GROUP BY doc_id, role) SELECT doc_id, '{{"doc_id":' || doc_id || ',"counts":[' || string_agg('{{"role":"' || role || '","n":' || n || '}}', ',' ORDER BY role) || ']}}' AS report FROM k GROUP BY doc_id""")
def report_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report a document as JSON, written as lines and read back."""
    counts = paras_of(spark, sf_dir).groupBy("doc_id", "role").agg(F.count("pos").alias("n"))
    reports = counts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("role", "n"))).alias("counts")).select(F.to_json(F.struct("doc_id", "counts")).alias("value"))
    folder = new_folder(spark, "reports")
    reports.write.text(folder)
    return spark.read.text(folder).select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), F.col("value").alias("report"))


# ---- events ----
@query("SELECT event_id, user_id, event_type FROM events WHERE user_id % 7 = 3")
def fresh_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the source that is active, as a token of its user; the others are stale."""
    events = table(spark, sf_dir, "events").withColumn("token", (F.col("user_id") % 7).cast("string"))
    return sp.fresh(events, "token", "3").select("event_id", "user_id", "event_type")


@query("""SELECT date_trunc('hour', ts) AS start, user_id, count(*) FILTER (event_type = 'purchase') AS completed, count(*) AS seen, round(count(*) FILTER (event_type = 'purchase')::DOUBLE / count(*), 4) AS ratio FROM events GROUP BY ALL""")
def hourly_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("done", F.col("event_type") == "purchase")
    return sp.progress(events, "user_id", "done", "ts")


@query("SELECT user_id, event_id, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS completed, count(*) OVER (PARTITION BY user_id) AS total FROM events")
def running_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.running(table(spark, sf_dir, "events").withColumn("done", F.col("event_type") == "purchase"), "user_id", "done", ["ts", "event_id"]).select("user_id", "event_id", "completed", "total")


@query("""WITH s AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, event_id, coalesce(before, 'none') AS from_state, event_type AS to_state FROM s WHERE before IS DISTINCT FROM event_type""")
def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.transitions(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"]).select("user_id", "event_id", "from_state", "to_state")


# ---- grids of thresholds ----
@query("""WITH g AS (SELECT f.f AS floor, u.u AS cut FROM (VALUES (0), (20), (60), (120)) f(f), (VALUES (0.1), (0.2), (0.3), (0.5)) u(u)), r AS (SELECT l.toxic, length(coalesce(d.text, '')) AS n, len(regexp_extract_all(coalesce(d.text, ''), '[aeiou]'))::DOUBLE / greatest(length(coalesce(d.text, '')), 1) AS share FROM documents d JOIN labels l USING (doc_id))
    SELECT floor, cut::DOUBLE AS cut, count(*) FILTER (n >= floor AND share >= cut AND toxic = 1) AS hits, count(*) FILTER (n >= floor AND share >= cut AND toxic = 0) AS false_hits, count(*) AS rows FROM r, g GROUP BY floor, cut""")
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and false hits of every pair of thresholds, counted in one pass over the rows: the grid is in the aggregate, not in a join."""
    t = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("toxic", F.length(t).alias("n"), (tx.matches(t, "[aeiou]") / F.greatest(F.length(t), F.lit(1))).alias("share"))
    grid = [(f, u) for f in (0, 20, 60, 120) for u in (0.1, 0.2, 0.3, 0.5)]
    one = lambda test: F.sum(F.when(test, 1).otherwise(0))
    hit = [(F.col("n") >= f) & (F.col("share") >= u) for f, u in grid]
    out = rows.agg(F.count(F.lit(1)).alias("rows"), *[one(h & (F.col("toxic") == 1)).alias(f"h{k}") for k, h in enumerate(hit)], *[one(h & (F.col("toxic") == 0)).alias(f"f{k}") for k, h in enumerate(hit)])
    cells = F.inline(F.array(*[F.struct(F.lit(f).alias("floor"), F.lit(float(u)).alias("cut"), F.col(f"h{k}").alias("hits"), F.col(f"f{k}").alias("false_hits"), F.col("rows").alias("rows")) for k, (f, u) in enumerate(grid)]))
    return out.select(cells)


@query("""WITH n AS (SELECT doc_id, lang, length(coalesce(text, '')) AS n, lead(length(coalesce(text, ''))) OVER (PARTITION BY lang ORDER BY doc_id) AS m, coalesce(text, '') AS t FROM documents)
    SELECT doc_id, concat_ws(',', CASE WHEN n > 0 AND m < n * 0.6 THEN 'too_short' END, CASE WHEN n > 0 AND m > n * 2.0 THEN 'too_long' END, CASE WHEN length(t) - length(replace(t, '(', '')) <> length(t) - length(replace(t, ')', '')) THEN 'unbalanced_brackets' END) AS risks FROM n WHERE m IS NOT NULL""")
def output_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks against an output of a text, here the next document of its language: length out of bounds, brackets that don't match."""
    from pyspark.sql import Window

    t = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.length(t).alias("n"), F.lead(F.length(t)).over(Window.partitionBy("lang").orderBy("doc_id")).alias("m"), t.alias("t")).where("m IS NOT NULL")
    n, m = F.col("n"), F.col("m")
    return rows.select("doc_id", tx.reasons(("too_short", (n > 0) & (m < n * 0.6)), ("too_long", (n > 0) & (m > n * 2.0)), ("unbalanced_brackets", tx.matches(F.col("t"), r"\(") != tx.matches(F.col("t"), r"\)"))).alias("risks"))
