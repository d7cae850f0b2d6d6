"""Aggregates: repeated furniture, document reports, rollups, checks, retention, fonts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as tx


def ratio(a: Column, b: Column) -> Column:
    """Guarded, four decimals: zero where the divisor is."""
    return F.when(b == 0, 0.0).otherwise(F.round(a / F.when(b == 0, 1).otherwise(b), 4))


def repeated_lines(rows: DataFrame, least: int = 3) -> DataFrame:
    """Short lines whose layout key stands in a document `least` times or more: (doc_id, key, n, first_pos, last_pos, mean_gap)."""
    short = rows.select("doc_id", "pos", tx.layout_key(F.col("text")).alias("key")).where((F.col("key") != "") & (F.length("key") <= 80))
    found = short.groupBy("doc_id", "key").agg(F.count("pos").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    return found.where(F.col("n") >= least).withColumn("mean_gap", F.round((F.col("last_pos") - F.col("first_pos")) / (F.col("n") - 1), 4))


def document_report(paragraphs: DataFrame) -> DataFrame:
    t = F.col("text")
    role = F.col("role")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    out = paragraphs.groupBy("doc_id").agg(F.count("pos").alias("n_rows"), one(role == "heading").alias("headings"), one(role == "list").alias("lists"), one(tx.is_page_number(t)).alias("page_numbers"), F.sum(F.length(t)).cast("long").alias("chars"), F.max(F.length(t)).alias("longest"))
    return out.withColumn("heading_share", ratio(F.col("headings"), F.col("n_rows")))


def usage_rollup(events: DataFrame, run: str, stage: str, cost: str) -> DataFrame:
    """Calls and cost of each stage of each run, and of each run (stage null): one pass, partial sums."""
    out = events.groupingSets([[F.col(run), F.col(stage)], [F.col(run)]], F.col(run), F.col(stage))
    return out.agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum(cost), 4).alias("cost"), F.count(cost).alias("costed"))


def check_table(report: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Three states: a check fails where it applies and doesn't pass. (key columns), failed array, verdict."""
    failed = F.filter(F.array(*[F.when(applies & ~passes, F.lit(name)) for name, (applies, passes) in sorted(checks.items())]), lambda x: x.isNotNull())
    return report.withColumn("failed", F.array_join(failed, ",")).withColumn("verdict", F.when(F.size(failed) == 0, "pass").otherwise("fail"))


def retained(files: DataFrame, group: str, age: str, name: str, most: int, oldest: float) -> DataFrame:
    """Per group: rows no older than `oldest`, the newest `most` of them by (age, name)."""
    order = Window.partitionBy(group).orderBy(F.col(age), F.col(name).desc())
    return files.where(F.col(age) <= oldest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mode_tiers(spans: DataFrame, group: str, size: str) -> DataFrame:
    """Per group the most frequent size (the least on a tie) and each size's tier over it: 0 near it, 1.. above, -1 below."""
    counts = spans.groupBy(group, size).agg(F.count(F.lit(1)).alias("n"))
    base = counts.groupBy(group).agg(F.max(F.struct("n", (-F.col(size)).alias("less"))).alias("m")).select(group, (-F.col("m.less")).alias("base"))
    met = counts.join(base, group)
    above = met.where(F.col(size) > F.col("base") + 0.25).withColumn("tier", F.dense_rank().over(Window.partitionBy(group).orderBy(F.col(size).desc())))
    rest = met.where(F.col(size) <= F.col("base") + 0.25).withColumn("tier", F.when(F.abs(F.col(size) - F.col("base")) <= 0.25, 0).otherwise(-1))
    return above.unionByName(rest)


def z_scores(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Population z-score, one decimal; zero where nothing varies. Moments are joined back, not windowed: groups may be large."""
    moments = rows.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    met = rows.join(moments, group)
    return met.withColumn("z", F.when(F.col("sd") < 1e-9, 0.0).otherwise(F.round((F.col(value) - F.col("mean")) / F.when(F.col("sd") < 1e-9, 1).otherwise(F.col("sd")), 1))).drop("mean", "sd")


def jaccard(a: Column, b: Column) -> Column:
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def retained_groups(files: DataFrame, owner: str, group: str, age: str, most: int, oldest: float) -> DataFrame:
    """As retained(), by groups that stay or go whole: a group is as old as its oldest member."""
    groups = files.groupBy(owner, group).agg(F.max(age).alias("age"), F.count(F.lit(1)).alias("members"))
    order = Window.partitionBy(owner).orderBy("age", F.col(group).desc())
    return groups.where(F.col("age") <= oldest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("age")


def retained_protecting(files: DataFrame, protected: DataFrame, group: str, age: str, name: str, most: int, oldest: float) -> DataFrame:
    """The protected files and, of the others, those that retained() keeps. protected: (group, name)."""
    others = files.join(protected, [group, name], "left_anti")
    return protected.select(group, name).unionByName(retained(others, group, age, name, most, oldest).select(group, name))


def usage_ledger(calls: DataFrame, run: str, stage: str) -> DataFrame:
    """Calls, tokens and cost of each stage of each run, and of each run (stage null).

    calls: prompt, completion, total, cost, each null where unreported; a total that is missing is the sum of
    the others, and a call with no token count at all is unreported, whatever it cost.
    """
    c = F.col
    reported = c("prompt").isNotNull() | c("completion").isNotNull() | c("total").isNotNull()
    zero = lambda x: F.coalesce(x, F.lit(0))
    rows = calls.select(run, stage, zero("prompt").alias("p"), zero("completion").alias("c"), F.coalesce("total", zero("prompt") + zero("completion")).alias("t"), zero(F.when(c("cost") >= 0, c("cost"))).alias("usd"), reported.alias("reported"))
    missing = F.sum(F.when(c("reported"), 0).otherwise(1))
    out = rows.groupingSets([[c(run), c(stage)], [c(run)]], c(run), c(stage))
    return out.agg(F.count(F.lit(1)).alias("calls"), F.sum("p").alias("prompt_tokens"), F.sum("c").alias("completion_tokens"), F.sum(F.when(c("reported"), c("t")).otherwise(0)).alias("total_tokens"), F.round(F.sum("usd"), 4).alias("cost"), missing.alias("unreported"), (missing == 0).alias("complete"))


def placeholder_integrity(expected: DataFrame, rows: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, id, status): ok, lost or duplicated for each expected placeholder, unexpected for others. expected: (doc_id, id)."""
    have = rows.select("doc_id", F.explode(tx.found(F.col("text"), pattern)).alias("id")).groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("n"))
    met = expected.withColumn("wanted", F.lit(True)).join(have, ["doc_id", "id"], "full")
    return met.select("doc_id", "id", F.when(F.col("wanted").isNull(), "unexpected").when(F.col("n").isNull(), "lost").when(F.col("n") == 1, "ok").otherwise("duplicated").alias("status"))


def pairwise(judged: DataFrame) -> DataFrame:
    """(candidate, comparisons, credit, decisive_wins, win_rate) from (left, right, winner, margin); a tie is half a win for both."""
    c = F.col
    sides = F.explode(F.array("left", "right")).alias("candidate")
    rows = judged.select(sides, "winner", "margin")
    credit = F.when(c("winner") == "tie", 0.5).when(c("winner") == c("candidate"), 1.0).otherwise(0.0)
    out = rows.groupBy("candidate").agg(F.count("winner").alias("comparisons"), F.sum(credit).alias("credit"), F.sum(F.when((c("winner") == c("candidate")) & (c("margin") == "decisive"), 1).otherwise(0)).alias("decisive_wins"))
    return out.withColumn("win_rate", F.round(c("credit") / c("comparisons"), 4))
