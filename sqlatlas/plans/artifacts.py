"""Queries over what leaves and enters the engine: layouts, exports, prompts, tokens, workspaces, catalogues and sources, with checking SQL."""

# ruff: noqa: E501
from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..functions import lexer, render
from ..operators import layout
from ..operators.flow import Options
from ..sources import catalogue, workspace
from ..sources.corpus import pasted, read_files, samples, split_objects
from . import engine
from .queries import _customers, _procedure, query, table, units
from .shared import shared_folder

_CHAIN = _procedure("'EXEC p;', repeat(' UPDATE t SET a = 1;', int(c_custkey % 3))")
_LOOPS = _procedure("'EXEC p;', repeat(' WHILE @a < 3 SET @a = @a + 1;', int(c_custkey % 4))")


def _chain(spark, sf_dir):
    return _customers(spark, sf_dir, _CHAIN, dialect="tsql", mode="flow")


@query("""SELECT c_custkey, 'n' || (r + 1) AS id, CAST(r AS INT) AS rank, 0 AS place, CASE WHEN r IN (0, 2 + c_custkey % 3) THEN 445.0 ELSE 430.0 END AS x, 45.0 + 145 * r AS y,
  CASE WHEN r IN (0, 2 + c_custkey % 3) THEN 150 ELSE 180 END AS w, CASE WHEN r IN (0, 2 + c_custkey % 3) THEN 58 ELSE 60 END AS h FROM customer, range(0, 5) t(r) WHERE r <= 2 + c_custkey % 3""")
def layout_chain(spark, sf_dir):
    """A chain: one node a layer, layers 145 apart, centred on one axis; ends are rounded boxes."""
    rows, got = _chain(spark, sf_dir)
    places = layout.layouts(got).drop("ord")
    return rows.select("unit_id", "c_custkey").join(places, "unit_id").drop("unit_id").select("c_custkey", "id", "rank", "place", "x", "y", "w", "h")


@query("""SELECT c_custkey, 3 + c_custkey % 4 AS layers, CAST(0 AS BIGINT) AS crossings, CAST(0 AS BIGINT) AS overlaps, c_custkey % 4 AS back_edges, 2 + 3 * (c_custkey % 4) AS backbone_edges, 2 + 2 * (c_custkey % 4) AS monotonic_edges, CAST(0 AS BIGINT) AS path_edges
FROM customer WHERE c_custkey % 4 < 2""")
def layout_reports(spark, sf_dir):
    """A loop adds its test, its body, a way in, a way back against the layers and a way on; body and way on lie in one layer."""
    rows, got = _customers(spark, sf_dir, _LOOPS, dialect="tsql", mode="flow")
    told = layout.layout_reports(got).drop("warning")
    return rows.filter("c_custkey % 4 < 2").select("unit_id", "c_custkey").join(told, "unit_id").drop("unit_id")


@query("SELECT c_custkey, 3 + c_custkey % 3 AS vertices, 2 + c_custkey % 3 AS edges, 3 + c_custkey % 3 AS traced, 1 + c_custkey % 3 AS spans FROM customer")
def drawio_cells(spark, sf_dir):
    """Cells of the draw.io file, read back; every vertex tells where it comes from, statements with their place in the text."""
    rows, got = _chain(spark, sf_dir)
    xml = render.drawio(got)
    count = lambda pattern: F.regexp_count("xml", F.lit(pattern)).cast("long")
    told = xml.select("unit_id", count(' vertex="1" ').alias("vertices"), count(' edge="1" ').alias("edges"), count('data-origin="cls=[^"]*provenance=').alias("traced"), count('data-origin="cls=[^"]*span=[0-9]+-[0-9]+').alias("spans"))
    return rows.select("unit_id", "c_custkey").join(told, "unit_id").drop("unit_id")


@query("SELECT c_custkey, true AS asks, true AS has_sql, true AS has_diagram, 'T-SQL' AS dialect, CAST(3 + c_custkey % 3 AS INT) AS nodes FROM customer")
def prompt_parts(spark, sf_dir):
    rows, got = _chain(spark, sf_dir)
    both = rows.select("unit_id", "c_custkey", "sql").join(got, "unit_id")
    diagram = render.mermaid(F.col("nodes"), F.col("edges"))
    p = both.select("c_custkey", "sql", diagram.alias("d"), render.narration_prompt(diagram, F.col("sql"), F.col("dialect")).alias("p"))
    name = F.regexp_extract("p", r"SQL \(([^)]*)\):", 1)
    return p.select("c_custkey", F.col("p").startswith("Reword").alias("asks"), F.col("p").contains(F.col("sql")).alias("has_sql"), F.col("p").contains(F.col("d")).alias("has_diagram"), name.alias("dialect"), F.regexp_count("p", F.lit(r"(?m)^  n[0-9]+[^ ]")).alias("nodes"))


@query("SELECT 1.0 AS parity_rate, CAST(sum(3 + c_custkey % 3) AS DOUBLE) / sum(3 + c_custkey % 3) AS traced_rate, 1.0 AS layout_rate FROM customer")
def export_rates(spark, sf_dir):
    got = engine.export_metrics(_chain(spark, sf_dir)[1])
    return got.select(*(F.col(c).cast("double").alias(c) for c in got.columns))


# --- tokens ---------------------------------------------------------------------------------------------

_TEXT = "concat('SELECT [a ', s_suppkey, '], \"q\"\"', s_suppkey, '\", `z` -- note ''', s_suppkey, '\n  /* a /* b */ */ <> 0x1F != 1e5 || $$d', s_suppkey, '$$ ::int @v #t', s_suppkey, ' .5 <= >= :: ; \t''it''''s''')"
_TOKENS = (
    ("word", "SELECT", True), ("word", "[a {k}]", False), ("op", ",", False), ("word", '"q""{k}"', False), ("op", ",", False), ("word", "`z`", False), ("op", "<>", True), ("num", "0x1F", False), ("op", "!=", False), ("num", "1e5", False),
    ("op", "||", False), ("dollar", "$$d{k}$$", False), ("word", "::int", False), ("word", "@v", False), ("word", "#t{k}", False), ("num", ".5", False), ("op", "<=", False), ("op", ">=", False), ("word", "::", False), ("op", ";", False), ("str", "'it''s'", False),
)


@query("SELECT s_suppkey, i AS ord, kind, replace(v, '{k}', CAST(s_suppkey AS VARCHAR)) AS v, nl FROM supplier, (VALUES " + ", ".join("({}, '{}', '{}', {})".format(i, k, v.replace("'", "''"), str(nl).lower()) for i, (k, v, nl) in enumerate(_TOKENS)) + ") t(i, kind, v, nl)")
def lex_kinds(spark, sf_dir):
    """Quoted names, comments, numbers, operators, dollar quotes and strings, and whether a token begins a line."""
    rows = units(table(spark, sf_dir, "supplier"), _TEXT, "s_suppkey")
    return lexer.tokens(rows).select(F.col("unit_id").cast("long").alias("s_suppkey"), F.col("ord").cast("int").alias("ord"), "kind", "v", "nl")


# --- sources --------------------------------------------------------------------------------------------


@query("SELECT kind, count(*) AS objects FROM (SELECT CASE r_regionkey % 2 WHEN 0 THEN 'VIEW' ELSE 'TABLE' END AS k, CASE r_regionkey % 2 WHEN 0 THEN 'VIEW' ELSE 'SCRIPT' END AS kind FROM region) GROUP BY kind")
def file_import(spark, sf_dir):
    """Text files written to the shared folder and imported again, a file a region."""
    path = f"{shared_folder(spark)}/import-{uuid.uuid4().hex}"
    text = F.expr("if(r_regionkey % 2 = 0, concat('CREATE VIEW v', r_regionkey, ' AS SELECT 1'), concat('CREATE TABLE t', r_regionkey, ' (a INT)'))")
    table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("file"), text.alias("value")).repartition("file").write.partitionBy("file").text(path)
    return split_objects(read_files(spark, path)).groupBy("kind").agg(F.count("*").alias("objects"))


@query("SELECT * FROM (VALUES ('db2', 'PROCEDURE', 'shop.restock'), ('pasted', 'SCRIPT', ''), ('plpgsql', 'FUNCTION', 'audit.note'), ('sqlite', 'TRIGGER', 'no_debt'), ('tsql', 'PROCEDURE', 'dbo.close_month')) v(file_id, kind, name)")
def sample_objects(spark, sf_dir):
    estate = engine.Estate(samples(spark).unionByName(pasted(spark, "SELECT 1; SELECT 2")))
    both = estate.units.select("unit_id", "file_id", F.col("kind").alias("unit_kind")).join(estate.rows, "unit_id")
    return both.select("file_id", F.when(F.col("unit_kind") == "PROC", "PROCEDURE").otherwise(F.col("unit_kind")).alias("kind"), "name")


@query("SELECT n_name AS name, 'SELECT ' || n_nationkey AS text, 'LR' AS dir, true AS saved, 2 AS version, false AS after FROM nation")
def workspace_round_trip(spark, sf_dir):
    """Saved, found, exported, loaded and cleared: every file comes back."""
    path = f"{shared_folder(spark)}/workspace-{uuid.uuid4().hex}"
    files = [(r.n_name, f"SELECT {r.n_nationkey}") for r in table(spark, sf_dir, "nation").select("n_name", "n_nationkey").collect()]
    workspace.save(workspace.snapshot(spark, files, {"dir": "LR"}), path)
    saved, version = workspace.exists(spark, path), json.loads(workspace.export_text(spark, path))["version"]
    names = [(f["name"], f["text"], r["dir"]) for r in workspace.load(spark, path).select("files", "dir").collect() for f in r["files"]]
    workspace.clear(spark, path)
    after = workspace.load(spark, path) is not None
    return spark.createDataFrame([(*n, saved, version, after) for n in names], "name string, text string, dir string, saved boolean, version int, after boolean")


@query("""SELECT upper('dbo.' || n_name) AS norm, 'verified' AS resolution, 'dbo.' || n_name AS canonical, (SELECT count(*) FROM nation) || ' objects, 1 column' AS summary FROM nation
UNION ALL SELECT upper('syn.' || n_name), 'verified', 'dbo.' || n_name, (SELECT count(*) FROM nation) || ' objects, 1 column' FROM nation WHERE n_nationkey % 2 = 0""")
def catalogue_json(spark, sf_dir):
    """The JSON form: of entries that repeat a name the first counts; a synonym may be a text or a list."""
    names = [(r.n_nationkey, r.n_name) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()]
    objects = [{"name": f"dbo.{n}", "kind": "tbl" if k % 3 else "view", **({"synonyms": [f"syn.{n}"] if k % 4 else f"syn.{n}"} if k % 2 == 0 else {})} for k, n in names]
    objects += [{"name": f"DBO.[{n.upper()}]", "kind": "view"} for _, n in names] + [{"kind": "table"}, 7]
    known = catalogue.parse_catalogue(json.dumps({"objects": objects, "columns": [{"table": "dbo.x", "name": "id"}, {"table": "dbo.y"}]}))
    return catalogue.index_frame(spark, known).withColumn("summary", F.lit(known.summary))


@query("SELECT true AS fresh, true AS stale FROM region WHERE r_regionkey = 0")
def snapshot_check(spark, sf_dir):
    """A stored metrics snapshot verifies against its own corpus, and fails against another one."""
    _, one = _customers(spark, sf_dir, _CHAIN, dialect="tsql", mode="flow")
    _, other = _customers(spark, sf_dir, _procedure("'EXEC(@s);'"), dialect="tsql", mode="flow")
    kept = engine.metrics_snapshot(one)
    engine.verify_snapshot(one, kept)
    try:
        engine.verify_snapshot(other, kept)
        stale = False
    except ValueError:
        stale = True
    return spark.createDataFrame([(True, stale)], "fresh boolean, stale boolean")
