"""Every query with an oracle against DuckDB, on the smallest tables; and the entry points without their optional part."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from folio import queries as library

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "NULL" if math.isnan(value) else f"{value + 0:.6g}"
    return "NULL" if value is None else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(library.QUERIES))
def test_query_matches_its_oracle(spark, duck, name):
    df = library.QUERIES[name](spark, SF)
    found = duck.execute(library.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, found.fetchall())


def test_entry_points_import_without_a_session():
    root = Path(__file__).resolve().parent.parent
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()[-1]) > 40


def test_edits_need_the_hash_they_were_made_for(spark):
    from folio.operators.sequences import apply_edits

    rows = spark.createDataFrame([(1, 0, "a the b"), (1, 1, "c"), (1, 2, None)], "doc_id long, pos int, text string")
    hashed = spark.sql("SELECT substring(sha2('c', 256), 1, 16) AS h").first().h
    edits = spark.createDataFrame([(1, 0, "remove_noise", "0" * 16, "the"), (1, 1, "delete_block", hashed, None)], "doc_id long, pos int, op string, text_hash string, noise string")
    got = {r.pos: (r.outcome, r.text) for r in apply_edits(rows, edits).collect()}
    assert got == {0: ("stale", "a the b"), 1: ("applied", None), 2: ("none", None)}


def test_chunks_never_exceed_the_budget_but_for_one_long_row(spark):
    from folio.operators.sequences import greedy_chunks

    rows = spark.createDataFrame([(1, k, "x" * n) for k, n in enumerate([4, 4, 30, 1, 1, 1])], "doc_id long, pos int, text string")
    got = sorted((r.chunk, r.n_rows, r.n_chars) for r in greedy_chunks(rows, 10).collect())
    assert got == [(0, 2, 10), (1, 1, 30), (2, 3, 7)]


def test_stream_progress(spark, tmp_path):
    from folio.streaming.progress import fresh, progress

    rows = spark.createDataFrame([("2024-01-01 00:00:10", "s", "a", True), ("2024-01-01 00:10:00", "s", "a", False), ("2024-01-01 00:11:00", "old", "a", True)], "ts string, token string, k string, done boolean").selectExpr("to_timestamp(ts) AS ts", "token", "k", "done")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = progress(fresh(stream, "token", "s"), "k", "done", "ts").writeStream.format("memory").queryName("progress_test").outputMode("complete").start()
    try:
        q.processAllAvailable()
        assert [(r.k, r.completed, r.seen, r.ratio) for r in spark.table("progress_test").collect()] == [("a", 1, 2, 0.5)]
    finally:
        q.stop()


def test_forms_keep_every_line(spark):
    text = "\n".join(f"Line {k} " + "long words " * 9 + "end" for k in range(40))
    from folio.sources.tables import marked, paragraphs

    got = marked(paragraphs(spark.createDataFrame([(3, text), (2, None)], "doc_id long, text string"))).orderBy("doc_id", "pos").collect()
    own = [r for r in got if r.doc_id == 3]
    assert [r.pos for r in own] == list(range(80)) and [r.pos for r in got if r.doc_id == 2] == [0, 1]
    for k, line in enumerate(text.split("\n")):
        form = own[2 * k].text
        assert line.lower() in form.lower() or (3 + k) % 16 == 10 and len(form) == len(line)


def test_registry_join_reads_every_order(spark, tmp_path):
    spark.createDataFrame([(k, 1) for k in (1, 2, 3, 6, 9)] + [(None, 1)], "l_orderkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, "F") for k in (1, 3, 6)], "o_orderkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.l_orderkey: (r.found, r.o_orderstatus) for r in library.QUERIES["registry_left_join"](spark, str(tmp_path)).collect()}
    assert got == {k: (True, "F") if k in (1, 3, 6) else (False, None) for k in (1, 2, 3, 6, 9, None)}


def test_runs_keep_null_keys_together_and_chunks_take_null_texts(spark):
    from folio.operators.sequences import greedy_chunks, runs

    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (1, 2, None), (1, 3, "a"), (2, 0, None)], "doc_id long, pos int, text string")
    got = sorted((r.doc_id, r.first_pos, r.key, r.length) for r in runs(rows, rows.text).collect())
    assert got == [(1, 0, "a", 1), (1, 1, None, 2), (1, 3, "a", 1), (2, 0, None, 1)]
    assert sorted((r.doc_id, r.chunk, r.n_rows, r.n_chars) for r in greedy_chunks(rows, 100).collect()) == [(1, 0, 4, 8), (2, 0, 1, 0)]
