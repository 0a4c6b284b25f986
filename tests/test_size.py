"""What keeps large estates within time: tasks for all cores, only the columns asked for, layouts that convert little."""

import pyarrow as pa
import pytest
from sqlatlas.operators import layout
from sqlatlas.operators.analysis import analyse
from sqlatlas.plans import engine, queries

SMALL = "/root/testdata/sf0.001"
TEXTS = (
    None, "", "SELECT 1 FROM a JOIN b ON 1 = 1", "SELECT 'open", "WITH RECURSIVE r AS (SELECT 1 FROM r) SELECT * FROM r, UNNEST(x)", "EXEC(@s); END",
    "CREATE PROCEDURE p @a INT AS BEGIN IF @a > 1 SELECT x INTO #t FROM b; SELECT * FROM #t; BEGIN TRY EXEC q; END TRY BEGIN CATCH THROW; END CATCH; GOTO lost; RETURN 0; END",
    "CREATE FUNCTION f() AS $$ BEGIN COMMIT; EXIT b; END $$ LANGUAGE plpgsql", "PRAGMA x; SELECT RAISE(ABORT, 1)",
)


@pytest.mark.parametrize("mode", ["auto", "flow", "query"])
@pytest.mark.parametrize("dialect", ["auto", "tsql", "plpgsql"])
def test_a_column_alone_is_that_of_the_whole_row(dialect, mode):
    for sql in TEXTS:
        whole = analyse(sql, dialect, mode)
        assert set(whole) == set(engine.KINDS)
        for c in whole:
            assert analyse(sql, dialect, mode, columns=[c]) == {c: whole[c]}


def test_units_of_one_partition_are_dealt_over_all_cores(spark):
    units = spark.range(400, numPartitions=1).selectExpr("cast(id as string) as unit_id", "'SELECT 1' as sql")
    sizes = engine.analysed(units, columns=("name",)).rdd.glom().map(len).collect()
    assert sum(sizes) == 400 and max(sizes) < 100 and len(sizes) >= 4 * spark.sparkContext.defaultParallelism


#: What the Python stage of a query hands over.
COLUMNS = {
    "cfg_exits": "edges nodes",
    "drawio_files": "edges nodes",
    "goto_unresolved": "ast",
    "layout_positions": "edges nodes",
    "facts_writes": "writes",
    "construct_totals": "constructs",
    "fuzz_invariants": "attribution coverage edges nodes tokens_total",
    "prompts": "dialect edges nodes",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_queries_deal_units_and_ask_for_few_columns(spark, name):
    plan = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    stage = next(x for x in plan.splitlines()[::-1] if "MapInArrow" in x)
    made = {x.split("#")[0].strip() for x in stage.split("[")[1].split("]")[0].split(",")} - {"unit_id"}
    assert "RepartitionByExpression [unit_id" in plan and sorted(made) == COLUMNS[name].split()


def test_graphs_of_a_batch_hold_what_a_layout_reads():
    rows = [{"unit_id": str(k), **analyse(sql, "tsql", "flow", columns=("nodes", "edges"))} for k, sql in enumerate(TEXTS)]
    whole = pa.RecordBatch.from_pylist([*rows, {"unit_id": "none", "nodes": None, "edges": None}])
    got = list(layout.graphs(whole.slice(3)))
    assert [set(n) for nodes, _ in got for n in nodes[:1]] == [{"id", "shape", "cls"}] * (len(rows) - 3)
    assert [layout.lay_out(*g) for g in got[:-1]] == [layout.lay_out(r["nodes"], r["edges"]) for r in rows[3:]] and not got[-1][0]
