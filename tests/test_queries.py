"""Every registered query of the core: the rows of its SQL where it has one, else that it runs; equality on small tables."""

import datetime
import os
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from foliant.plans import registry

DATA = "/root/testdata/sf0.001"
WITHOUT_SQL = sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL))


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    yield con
    con.close()


def plain(value):
    """Values of both engines as text that compares."""
    if isinstance(value, dict):
        return plain(list(value.values()))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    if isinstance(value, (float, Decimal)):
        return f"{float(value):.7g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, tables, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    answer = tables.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in answer.fetchall())


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() >= 0


def test_names_are_documented_once():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert len(WITHOUT_SQL) < 10 and os.path.isdir(DATA)


def test_stub_embeddings_round_small_negative_numbers_as_their_sql_does(spark, tmp_path):
    texts = [(1, "text 243183"), (2, "text 256169"), (3, "text 547724"), (4, ""), (5, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    expected = con.execute(registry.ORACLE_SQL["stub_embeddings"]).fetchall()
    con.close()
    got = [(r["doc_id"], r["vector"]) for r in registry.QUERIES["stub_embeddings"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))  # repr tells -0.0 from 0.0
    assert "-0.0," in repr(expected)


def test_quoted_spans_of_texts_without_a_sentence_are_those_of_their_sql(spark, tmp_path):
    full = "Alpha beta is here. Gamma delta was there! " * 12
    texts = [None, "", " ", "   ", " " * 500, "\n", "\n" * 500, ".", ". . .", "word", full, full + "Beta.", full + "  ?  "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    expected = con.execute(registry.ORACLE_SQL["quoted_spans"]).fetchall()
    con.close()
    got = [tuple(r) for r in registry.QUERIES["quoted_spans"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=lambda r: r[0]) == sorted(expected) and len(expected) == len(texts)


def test_narrated_conflicts_reads_statements_once_and_makes_their_texts_after_the_shuffle(spark):
    plan = registry.QUERIES["narrated_conflicts"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1
    assert plan.index("repeat(") < plan.index("Window [")  # the root comes first


def test_chunk_documents_marks_lines_once_and_places_them_by_counting_headings(spark):
    from foliant.operators import library, structure
    from foliant.plans import texts

    plan = registry.QUERIES["chunk_documents"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "_norm" not in plan and "Generate explode(split(" not in plan  # stored lines are read
    lines = structure.marked_lines(texts.policy_lines(spark, DATA)).cache()
    told, heads = structure.headings(lines, every=True), structure.headings(lines)
    columns = ["doc_id", "line_no", "number", "title", "level"]
    assert told.count() == lines.count()
    assert sorted(map(str, told.filter("title IS NOT NULL").select(columns).collect())) == sorted(map(str, heads.select(columns).collect()))
    tree = structure.section_tree(heads, lines.groupBy("doc_id").agg({"page": "max"}).toDF("doc_id", "last_page"))
    want = library.carried_sections(lines, tree).select("doc_id", "line_no", "section").collect()
    assert sorted(map(str, structure.in_sections(told).select("doc_id", "line_no", "section").collect())) == sorted(map(str, want))
