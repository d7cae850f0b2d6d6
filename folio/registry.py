"""Where queries and their SQL are registered, and the tables both read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.plans.sql import E
from folio.sources import tables as src
from folio.sources.tables import marked, paragraph_table, paragraphs, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(table(spark, sf_dir, "documents"))


def forms_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(lines_of(spark, sf_dir))


def paras_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_table(forms_of(spark, sf_dir))


def named_sql(columns: dict) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in columns.items())


# ---- the same tables as SQL ----

T, N, D = E("text"), E("pos"), E("doc_id")
LINES = """
p AS MATERIALIZED (SELECT doc_id, (i - 1)::INTEGER AS pos, lines[i] AS text FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)))"""
FORMS = f"""{LINES},
m AS MATERIALIZED (SELECT doc_id, 2 * pos AS pos, {src.line_form(T, N, D)} AS text FROM p UNION ALL SELECT doc_id, 2 * pos + 1, {src.companion(N, D)} FROM p)"""
_LEVEL, _ROLE, _STRUCTURAL = src.roles(T, E("style_name"), E("alignment"))
PARAS = f"""{FORMS},
q AS (SELECT doc_id, pos, text, {named_sql(src.attributes(T, N, D))} FROM m),
q2 AS (SELECT *, {_LEVEL} AS heading_level, {_ROLE} AS role, {_STRUCTURAL} AS structural_role FROM q),
para AS MATERIALIZED (SELECT *, CASE WHEN role = 'image' THEN text END AS asset_id FROM q2)"""


def c(name: str) -> E:
    return E(name)


def with_(body: str, tables: str = PARAS, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{tables}{body}"
