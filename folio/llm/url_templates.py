"""URL verdicts: rules first, then a path-template tree, with DataFrame operations alone.

A rule is a host and the beginning of a path; it fits its host and all
subdomains, and the longest that fits decides. Pages that a rule decides are the
labels of the method: a branch of a host's path tree is judged by the share of
them that is blocked.

Per host, the segments of a path are the tree: DEPTH levels at once, then as many
more as paths share, until a branch ends or holds one shape alone, whose other
segments are its own. A segment with a digit, or of more than LONG characters,
is variable: "{}". Level by level a
branch becomes the wildcard "*" where its parent has many different children
(MANY at least, more than half as many as pages) or where it is statistically
like its siblings: its blocked share is within 1.96 standard errors of its
parent's, or none of its pages is labelled. What is left apart is a template.

Its blocked share is smoothed towards its host's, and that towards the whole
table's; purity is one less that share, and a template of purity under one half
is blocked. All of it works on distinct shapes of paths, counted once by
partial sums, so a host that has a third of the pages is a few rows.

Defined cases: a null url, or one without "://", has an empty host and path and
is judged by the template of those; equal urls are judged alike; a null page_id
keeps its row; with no labelled page every purity is one half, which is allowed;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.rows import lower_ascii
from folio.session import written

#: Fixed values of the contract: host, beginning of the path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DEPTH = 3
LONG = 24
MANY = 20
#: Pseudo-pages by which a host's share and a template's share are smoothed.
HOST_WEIGHT, TEMPLATE_WEIGHT = 1.0, 4.0


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own, start, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(start))
        name, verdict = F.when(fits, F.lit(own + start)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def shape(path: Column) -> Column:
    """All segments, variable ones as "{}"."""
    segments = F.split(path, "/", -1)
    return F.transform(F.slice(segments, F.lit(2), F.size(segments)), lambda s: F.when(F.rlike(s, F.lit("[0-9]")) | (F.length(s) > LONG), F.lit("{}")).otherwise(s))


def counted(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))


def level_of(out: DataFrame, above: list[str], own: str, name: str) -> DataFrame:
    """out with the template's segment beside the own one; `above` is what leads there."""
    child = counted(out, [*above, own])
    parent = counted(child, above)
    kids = child.groupBy(*above).agg(F.count("n").alias("kids"))
    parent = parent.join(kids, above).select(*above, "kids", F.col("n").alias("pn"), F.col("labelled").alias("pl"), F.col("bad").alias("pb"))
    p = F.col("pb") / F.greatest("pl", F.lit(1))
    like = (F.col("labelled") == 0) | (F.abs(F.col("bad") / F.greatest("labelled", F.lit(1)) - p) <= 1.96 * F.sqrt(p * (1 - p) / F.greatest("labelled", F.lit(1))))
    many = (F.col("kids") >= MANY) & (F.col("kids") * 2 > F.col("pn"))
    wild = (F.col(own) != "") & (F.col("kids") > 1) & (many | like)
    # Its own segment may be empty: a path's end, never a wildcard.
    branch = child.join(parent, above).select(*above, own, F.when(wild, F.lit("*")).otherwise(F.col(own)).alias(name))
    return out.join(branch, [*above, own])


def segment(level: int) -> Column:
    """get() of a place beyond the end is null; the empty string stands for it."""
    return F.coalesce(F.get("shape", F.lit(level - 1)), F.lit(""))


def grown(shapes: DataFrame) -> DataFrame:
    """shapes with their template."""
    out = shapes.withColumns({f"s{k}": segment(k) for k in range(1, DEPTH + 1)})
    for level in range(1, DEPTH + 1):
        out = level_of(out, ["host", *(f"t{k}" for k in range(1, level))], f"s{level}", f"t{level}")
    columns = [*shapes.columns, "above", "rest"]
    out = written(out.withColumns({"above": F.concat_ws("/", "host", *(f"t{k}" for k in range(1, DEPTH + 1))), "rest": F.lit("")}).select(columns), "templates")
    parts, level = [], DEPTH
    while (out.agg(F.max(F.size("shape"))).first()[0] or 0) > level:
        level += 1
        group = ["host", "above", "rest"]
        out = out.join(out.groupBy(*group).agg(F.count(F.lit(1)).alias("many"), F.max(F.size("shape")).alias("far")), group)
        own = F.array_join(F.slice("shape", F.lit(level), F.size("shape")), "/")
        # Branches that go no further, and the only shape of its branch, whose segments have no siblings.
        parts.append(written(out.where((F.col("far") < level) | (F.col("many") == 1)).withColumn("rest", F.when(F.col("far") < level, F.col("rest")).otherwise(F.concat_ws("/", "rest", own))).select(columns), "templates"))
        going = out.where((F.col("far") >= level) & (F.col("many") > 1)).withColumn("own", segment(level))
        out = written(level_of(going, group, "own", "next").withColumn("rest", F.concat_ws("/", "rest", "next")).select(columns), "templates")
    for part in parts:
        out = out.union(part)
    # Ends of paths beyond DEPTH are not written out.
    return out.withColumn("template", F.concat("above", F.regexp_replace("rest", "/+$", ""))).drop("above", "rest")


def url_verdicts(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every page."""
    url = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = url.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), shape(F.col("path")).alias("shape"))
    keys = ["host", "shape"]
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    own = rows.withColumns({"n": F.lit(1).cast("long"), "labelled": one(F.col("ruled").isNotNull()), "bad": one(F.col("ruled") == "block")})
    tree = written(grown(written(counted(own, keys), "shapes")), "templates")
    every = tree.agg(F.sum("bad"), F.sum("labelled")).first()
    share = ((every[0] or 0) + 1) / ((every[1] or 0) + 2)
    host = counted(tree, ["host"]).select("host", ((F.col("bad") + HOST_WEIGHT * share) / (F.col("labelled") + HOST_WEIGHT)).alias("host_share"))
    template = counted(tree, ["host", "template"]).join(host, "host").select("host", "template", (1 - (F.col("bad") + TEMPLATE_WEIGHT * F.col("host_share")) / (F.col("labelled") + TEMPLATE_WEIGHT)).alias("purity"))
    judged = tree.join(template, ["host", "template"]).select(*keys, "template", "purity")
    by_method = F.when(F.col("purity") < 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(judged, keys).select("page_id", "host", "path", "rule", F.coalesce("ruled", by_method).alias("verdict"), "template", "purity")


def op7_url_templates(pages: DataFrame) -> DataFrame:
    return url_verdicts(pages).select("page_id", "host", "path", "rule", "verdict", "template")


def _oracle() -> str:
    order = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [(f"(host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in order]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{name}'" for f, name, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits) + " END"
    levels = ["g0 AS (SELECT * FROM shapes)"]
    for level in range(1, DEPTH + 1):
        above = ", ".join(["host", *(f"t{k}" for k in range(1, level))])
        s = f"s{level}"
        levels.append(f"c{level} AS (SELECT {above}, {s}, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad FROM g{level - 1} GROUP BY {above}, {s})")
        levels.append(f"p{level} AS (SELECT {above}, count(*) AS kids, sum(n) AS pn, sum(labelled) AS pl, sum(bad) AS pb FROM c{level} GROUP BY {above})")
        like = "labelled = 0 OR abs(bad::DOUBLE / greatest(labelled, 1) - pb::DOUBLE / greatest(pl, 1)) <= 1.96 * sqrt((pb::DOUBLE / greatest(pl, 1)) * (1 - pb::DOUBLE / greatest(pl, 1)) / greatest(labelled, 1))"
        levels.append(f"b{level} AS (SELECT {above}, {s}, CASE WHEN {s} <> '' AND kids > 1 AND ((kids >= {MANY} AND kids * 2 > pn) OR {like}) THEN '*' ELSE {s} END AS t{level} FROM c{level} JOIN p{level} USING ({above}))")
        levels.append(f"g{level} AS (SELECT * FROM g{level - 1} JOIN b{level} USING ({above}, {s}))")
    tops = ", ".join(f"t{k}" for k in range(1, DEPTH + 1))
    keys = ", ".join(["host", *(f"s{k}" for k in range(1, DEPTH + 1))])
    segments = ", ".join(f"CASE WHEN len(parts) < {k + 1} THEN '' WHEN regexp_matches(parts[{k + 1}], '[0-9]') OR length(parts[{k + 1}]) > {LONG} THEN '{{}}' ELSE parts[{k + 1}] END AS s{k}" for k in range(1, DEPTH + 1))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{upper}', '{lower}') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, {rule} AS rule, {verdict} AS ruled, string_split(path, '/') AS parts FROM u),
k AS (SELECT *, {segments} FROM r),
shapes AS (SELECT {keys}, count(*) AS n, count(ruled) AS labelled, count(*) FILTER (ruled = 'block') AS bad FROM k GROUP BY {keys}),
{", ".join(levels)},
every AS (SELECT (sum(bad) + 1.0::DOUBLE) / (sum(labelled) + 2) AS share FROM shapes),
h AS (SELECT host, (sum(bad) + {HOST_WEIGHT}::DOUBLE * any_value(share)) / (sum(labelled) + {HOST_WEIGHT}::DOUBLE) AS host_share FROM shapes, every GROUP BY host),
t AS (SELECT host, {tops}, 1 - (sum(bad) + {TEMPLATE_WEIGHT}::DOUBLE * any_value(host_share)) / (sum(labelled) + {TEMPLATE_WEIGHT}::DOUBLE) AS purity FROM g{DEPTH} JOIN h USING (host) GROUP BY host, {tops})
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity < 0.5 THEN 'block' ELSE 'allow' END) AS verdict, concat_ws('/', host, {tops}) AS template
FROM k JOIN (SELECT {keys}, {tops}, purity FROM g{DEPTH} JOIN t USING (host, {tops})) j USING ({keys})"""


ORACLE = _oracle()
