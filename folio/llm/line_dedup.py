"""Line dedup with DataFrame operations alone.

A text is split at line feeds. A line's key is the line without white space at
both ends, A-Z lower-cased. Keys of at least MIN_CHARS characters found in at
least MIN_DOCS documents lose all their lines, except in the document of the
largest doc_id that holds them.

Keys travel as 128 bits of hash, and are taken from the texts once: (document,
place, key) is a written table. A document holding a key many times counts
once; the count and the largest doc_id are partial sums before any row moves.
A key with more than a HOT_SHARE-th of all lines to be judged is hot: there are
at most HOT_SHARE of them, which is what bounds their broadcast, and their lines
meet them where they are; the other lines are joined by key.
Dropped positions, not lines, are gathered by document, and a text is put
together again from the runs of lines between them, in one pass.

Defined cases: a null or empty text is one empty line; documents without a
dropped line keep their text as it is (null: empty); rows that share a doc_id
count as one document and are each judged alike by the lines they hold
themselves; a null doc_id is a document of its own that is smaller than any
other; an empty table gives no rows; other columns stay as they are, whatever
their names, but for n_lines and n_dropped where those are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.rows import lower_ascii
from folio.session import written

MIN_CHARS = 20
MIN_DOCS = 3
#: Hot keys hold more than one in so many of the lines whose key is frequent, and HOT_LINES at least.
HOT_SHARE, HOT_LINES = 4096, 1000
EDGE = " \t\n\x0b\x0c\r"
#: Stands for a null doc_id.
NO_ID = -(1 << 63)


def _lines(text):
    return F.split(text, "\n", -1)


def keyed_lines(own: DataFrame, min_chars: int) -> DataFrame:
    """(doc, digest, pos, a, b) of every line long enough to be judged."""
    key = lower_ascii(F.trim(F.col("line"), F.lit(EDGE)))
    lines = own.select("doc", "digest", F.posexplode(_lines(F.col("text"))).alias("pos", "line")).select("doc", "digest", "pos", key.alias("key")).where(F.length("key") >= min_chars)
    return lines.select("doc", "digest", "pos", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(7), F.col("key")).alias("b"))


def dropped_places(lines: DataFrame, min_docs: int, hot_lines: int = HOT_LINES) -> DataFrame:
    """(doc, digest, dropped): the ascending places of the lines that go. lines: a written table of keyed_lines()."""
    by_doc = lines.groupBy("a", "b", "doc").agg(F.count(F.lit(1)).alias("lines"))
    often = by_doc.groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs"), F.sum("lines").alias("lines"), F.max("doc").alias("last")).where(F.col("docs") >= min_docs)
    often = written(often.select("a", "b", "last", "lines"), "frequent-lines")
    least = max(hot_lines, (often.agg(F.sum("lines")).first()[0] or 0) // HOT_SHARE)
    hot, cold = F.broadcast(often.where(F.col("lines") > least).select("a", "b", "last")), often.where(F.col("lines") <= least).select("a", "b", "last")
    met = lines.join(hot, ["a", "b"]).unionByName(lines.join(hot, ["a", "b"], "left_anti").join(cold, ["a", "b"]))
    return met.where(F.col("doc") < F.col("last")).groupBy("doc", "digest").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, counts: bool = True) -> DataFrame:
    """docs with text replaced by what is kept; with `counts`, n_lines and n_dropped come last, in place of columns of those names."""
    # Rows are told apart by their content, which is the same whenever they are read again.
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text.alias("text"), F.xxhash64(text).alias("digest"))
    joined = own.join(dropped_places(written(keyed_lines(own, min_chars), "keyed-lines"), min_docs), ["doc", "digest"], "left").withColumn("all", _lines(F.col("text")))
    ends = joined.withColumn("ends", F.concat(F.array(F.lit(-1)), F.col("dropped"), F.array(F.size("all"))))
    runs = F.transform(
        F.sequence(F.lit(1), F.size("dropped") + 1),
        lambda i: F.slice(F.col("all"), F.element_at("ends", i) + 2, F.element_at("ends", i + 1) - F.element_at("ends", i) - 1),
    )
    # array_join() of one run after the other keeps the line feeds between them.
    kept = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    more = {"n_lines": F.size("all").cast("long"), "n_dropped": F.coalesce(F.size("dropped"), F.lit(0)).cast("long")} if counts else {}
    stay = [kept.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in more]
    return ends.select(*stay, *[value.alias(name) for name, value in more.items()])


def op6_line_dedup(docs: DataFrame) -> DataFrame:
    return drop_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_LINES = r"""
lines AS (
  SELECT doc_id, i, lines[i] AS line, translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), often AS (
  SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT l.doc_id, l.i, l.line, o.k IS NOT NULL AND l.doc_id < o.last AS gone FROM lines l LEFT JOIN often o ON l.k = o.k AND length(l.k) >= 20
)"""
ORACLE = f"""WITH {ORACLE_LINES}
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""
