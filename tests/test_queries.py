"""Every registered query against its SQL, and the shape of the main plans."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from palisade.plans import workload
from palisade.session import shared_dir
from tools_check import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    query = entry.queries()[name](spark, FOLDER)
    ours, theirs = query.toPandas(), db.execute(entry.oracle_sql()[name]).df()
    sql_types = {r[0]: r[1] for r in db.execute("DESCRIBE " + entry.oracle_sql()[name]).fetchall()}
    assert len(ours) and {c: TYPES[t] for c, t in query.dtypes} == sql_types
    assert canonical(ours) == canonical(theirs)


def test_every_query_has_sql_but_the_trained_model(spark):
    own = {n for n in entry.queries() if n in workload.QUERIES}
    assert own - set(entry.oracle_sql()) == {"train_intent", "trained_confusion"}


def test_blocks_lie_on_all_turns(spark):
    blocks = workload.page_blocks(spark, FOLDER).unionByName(workload.document_blocks(spark, FOLDER))
    turns = {r[0] for r in blocks.select(F.col("prompt_id") % 8).distinct().collect()}
    assert turns == {r[0] for r in workload.prompts(spark, FOLDER).select("turn").distinct().collect()}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_shared_dir_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_overlay_fires_every_rule(spark):
    rules = {r["rule_name"]: r["n_findings"] for r in workload.rule_report(spark, FOLDER).collect()}
    assert len(rules) == 8 and min(rules.values()) > 0


def test_scans_read_only_needed_columns(spark, plan_of):
    plan = plan_of(workload.clean_text(spark, FOLDER).select("cleaned_chars"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = plan_of(workload.prompts(spark, FOLDER).filter(F.col("role") == "user").select("text"))
    assert "EqualTo(role,user)" in plan


def test_tool_blocks_reach_prompts_of_every_kind(spark):
    rows = workload.keyword_tools(spark, FOLDER)
    counts = rows.agg(F.count_if(F.col("n_tools") > 0).alias("with_tools"), F.count_if(F.col("n_tools") == 0).alias("without")).first()
    assert counts["with_tools"] > 0 and counts["without"] > 0
    keys = workload.prompts(spark, FOLDER).select("prompt_id")
    for blocks in (workload.page_blocks(spark, FOLDER), workload.document_blocks(spark, FOLDER)):
        assert blocks.join(keys, "prompt_id", "left_anti").isEmpty()
    sources = workload.page_blocks(spark, FOLDER).select("source")
    assert sources.filter("source is null").count() and sources.filter(F.contains("source", F.lit("'"))).count()
