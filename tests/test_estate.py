"""Sources, estate graphs, catalogue, workspace, layout, renderers, streaming, and the queries against their SQL."""

import os
import re
import xml.dom.minidom

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from sqlatlas.functions import dialect, lexer, references, render
from sqlatlas.operators import estate as es
from sqlatlas.operators import layout
from sqlatlas.operators.analysis import detect
from sqlatlas.operators.flow import Options
from sqlatlas.plans import engine, queries
from sqlatlas.sources import catalogue, corpus, workspace
from sqlatlas.streaming import reanalyse

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(frame):
    return sorted(tuple("NULL" if pd.isna(v) else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    if name in queries.ORACLES:
        want = duck.sql(queries.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)
    else:
        assert len(got)


def files(spark, *texts):
    return spark.createDataFrame([(str(i), f"f{i}.sql", t) for i, t in enumerate(texts)], corpus.FILES)


def test_read_and_split(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.sql").write_text("-- x\nCREATE OR ALTER PROC p AS SELECT 1\nGO\nCREATE VIEW v AS SELECT 2")
    (tmp_path / "sub/b.ddl").write_text("SELECT 3")
    (tmp_path / "c.md").write_text("CREATE VIEW no AS SELECT 1")
    rows = corpus.split_objects(corpus.read_files(spark, str(tmp_path))).orderBy("file", "ord").collect()
    assert [(r.file, r.kind, r.sql[:9]) for r in rows] == [("a.sql", "PROC", "-- x\nCREA"), ("a.sql", "VIEW", "CREATE VI"), ("b.ddl", "SCRIPT", "SELECT 3")]
    assert corpus.split_objects(files(spark, None, "")).count() == 2
    assert corpus.split_objects(corpus.pasted(spark, "CREATE OR REPLACE VIEW v AS SELECT 1")).count() == 1


def test_windows_agree_with_the_scanner(spark):
    texts = ["SELECT 1 FROM a, b.c JOIN d.e.f ON 1 = 1, g", "SELECT 1 FROM (SELECT 2 FROM x, y) z, w", "MERGE t USING s ON 1 = 1", "SELECT 1 FROM t CROSS APPLY UNNEST(a), b", "SELECT f(1, 2) FROM q ORDER BY a, b", "SELECT 1 FROM [FROM], \"x\".y", "FROM", "FROM (", "SELECT 1 FROM a,"]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "unit_id string, sql string")
    got = {}
    for r in references.source_frame(lexer.tokens(rows), ["unit_id"]).orderBy("unit_id", "ord").collect():
        got.setdefault(r.unit_id, []).append((r.name, r.resolution, r.is_apply))
    for i, t in enumerate(texts):
        assert got.get(str(i), []) == [(r.name, r.resolution, r.apply) for r in references.sources(lexer.lex(t)[0]).refs], t


def test_dialects_agree(spark):
    texts = [*corpus.SAMPLES.values(), "", "LANGUAGE SQL", "LANGUAGE SQL plpgsql", "CREATE TRIGGER t FOR EACH ROW", "CREATE TRIGGER t FOR EACH ROW DECLARE", "a\nGO\nb", "x::int", "BEGIN TRY ELSIF"]
    rows = dialect.detect(spark.createDataFrame([(t,) for t in texts], "sql string")).collect()
    for r in rows:
        winner, score, confident, tied, _ = detect(r.sql)
        assert (r.dialect, r.score, r.confident, r.tied) == (winner, score, confident, tied)
    assert [r.dialect for r in rows[:4]] == list(corpus.SAMPLES)


def test_dependency_graph(spark):
    cat = catalogue.parse_catalogue("dbo.real TABLE dbo.alias\ndbo.twice\ndbo.twice")
    e = engine.Estate(files(spark, "CREATE VIEW v AS SELECT 1 FROM dbo.alias, DBO.TWICE, s.d.b.t", "CREATE PROC p AS EXEC q; INSERT INTO #x SELECT 1 FROM V", "CREATE PROC q AS SELECT 1", "CREATE PROC Q AS SELECT 2"), "tsql", catalogue=cat)
    nodes, edges = es.dependency_graph(e.objects, e.references, catalogue.index_frame(spark, cat))
    text = {r.id: r for r in nodes.collect()}
    to = {(text[r.src].text, text[r.dst].text, r.kind, r.style) for r in edges.collect()}
    assert to == {("v\nVIEW", "dbo.real", "dependency", "solid"), ("v\nVIEW", "DBO.TWICE", "dependency", "solid"), ("v\nVIEW", "external: s.d.b.t", "dependency", "solid"), ("p\nPROCEDURE", "Q\nPROCEDURE", "call", "solid"), ("p\nPROCEDURE", "#x", "data", "dotted"), ("p\nPROCEDURE", "v\nVIEW", "dependency", "solid")}
    assert {(r.text, r.provenance, r.resolution) for r in text.values() if r.id.startswith("x:")} == {("dbo.real", "external", "verified"), ("DBO.TWICE", "external", "conflict"), ("external: s.d.b.t", "external", None), ("#x", "synthetic", None)}
    kept, shown = es.filtered(nodes, edges, external=False, temp=False, calls=False)
    assert kept.count() == 4 and [r.kind for r in shown.collect()] == ["dependency"]
    kept, _ = es.filtered(nodes, edges, focus="nothing like it")
    assert kept.count() == 0
    e.register("t_")
    assert spark.sql("SELECT count(*) AS n FROM t_objects").first().n == 4


def test_stored_estate(spark, tmp_path):
    e = engine.Estate(corpus.samples(spark), options=Options()).stored(str(tmp_path))
    assert e.objects.count() == 4 and engine.health(e.rows).first().diagnostics == 0
    assert e.part("findings").columns[:3] == ["unit_id", "ord", "severity"]


def test_catalogue_rules():
    c = catalogue.parse_catalogue('{"objects": ["a", {"name": "[b]", "kind": "procedure", "synonyms": ["x", "a"]}, {"name": "B"}, {"no": 1}, null], "columns": [{"table": "a", "name": "i"}]}')
    assert [o[0] for o in c.objects] == ["a", "[b]"] and c.resolve("B") == ("verified", "[b]") and c.resolve("a")[0] == "conflict" and c.resolve("x")[1] == "[b]"
    assert c.summary == "2 objects, 1 column, 1 conflict" and c.objects[1][1] == "PROC"
    assert [f.code for f in catalogue.parse_catalogue("{").findings] == ["catalogue_parse_error"] and [f.code for f in catalogue.parse_catalogue("# no").findings] == ["catalogue_empty"]
    c = catalogue.parse_catalogue("t TABLE s1, s2\nCOLUMN t.a\n// note\nd.t")
    assert c.objects[0] == ("t", "TABLE", ["s1", "s2"]) and c.columns == [("t", "a")] and c.suffixes("srv.d.t") == ["t", "d.t"]


def test_workspace_round_trip(spark, tmp_path):
    path = str(tmp_path / "ws")
    assert workspace.load(spark, path) is None
    workspace.save(workspace.snapshot(spark, [("a.sql", "SELECT 1")], {"dir": "LR", "group": False}, "t TABLE", "tsql#0"), path)
    row = workspace.load(spark, path).first()
    assert (row.dir, row.group, row.catalogue, row.activeObjectId, row.files[0].text, row.migrated) == ("LR", False, "t TABLE", "tsql#0", "SELECT 1", False)
    assert '"version":2' in workspace.export_text(spark, path)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.txt").write_text("{no")
    assert workspace.load(spark, str(tmp_path / "bad")) is None and not os.path.exists(tmp_path / "bad")


def test_layout_and_renderers(spark):
    e = engine.Estate(corpus.samples(spark), mode="flow", options=Options(group=False, fan_in=True))
    for r in e.rows.select("unit_id", "nodes", "edges", render.mermaid(F.col("nodes"), F.col("edges")).alias("m")).collect():
        n, w = [x.asDict() for x in r.nodes], [x.asDict() for x in r.edges]
        for d in ("TD", "LR"):
            spots, report = layout.lay_out(n, w, d)
            assert report["overlaps"] == 0 and len(spots) == len(n) and spots == layout.lay_out(n, w, d)[0]
        lines = r.m.split("\n")
        assert lines[0] == "flowchart TD" and sum(bool(re.match(r"  n\d+ (-->|-\.->)", x)) for x in lines) == len(w)
        assert sum(x.startswith("%% n") for x in lines) == len(n)
    for r in render.drawio(e.rows).collect():
        cells = xml.dom.minidom.parseString(r.xml).getElementsByTagName("mxCell")
        row = e.rows.filter(F.col("unit_id") == r.unit_id).first()
        assert len(cells) == 2 + len(row.nodes) + len(row.edges)
    long = spark.createDataFrame([("d", "x" * 50_000, "db2")], "m string, s string, d string").select(render.narration_prompt(F.col("m"), F.col("s"), F.col("d")).alias("p")).first().p
    assert "cut here" in long and "DB2 SQL PL" in long and len(long) < 41_000


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in corpus.SAMPLES.items():
        (tmp_path / f"in/{name}.sql").write_text(text)
    go = lambda: reanalyse.reanalyse(reanalyse.file_stream(spark, str(tmp_path / "in"), 2), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    go()
    batch = engine.Estate(corpus.read_files(spark, str(tmp_path / "in")))
    want = {(r.name, len(r.nodes)) for r in batch.rows.collect()}
    assert {(r.name, len(r.nodes)) for r in reanalyse.latest(spark, str(tmp_path / "out")).collect()} == want
    go()  # nothing new
    assert reanalyse.latest(spark, str(tmp_path / "out")).count() == 4


def test_snapshot_and_diagnostics(spark):
    cat = catalogue.parse_catalogue("a\na")
    e = engine.Estate(corpus.samples(spark), catalogue=cat)
    stored = engine.metrics_snapshot(e.rows)
    engine.verify_snapshot(e.rows, stored)
    with pytest.raises(ValueError, match="stale"):
        engine.verify_snapshot(e.rows, stored.replace("1.0", "0.5"))
    got = e.diagnostics.filter("code = 'catalogue_conflict'").collect()
    assert len(got) == 5 and sum(r.unit_id is None for r in got) == 1
    assert e.tokens.filter("kind = 'dollar'").count() == 1


def test_sql_functions(spark):
    from sqlatlas.functions.register import register

    register(spark)
    rows = spark.sql("SELECT f.kind, f.reads FROM VALUES ('SELECT 1 FROM a; EXEC(@s)') t(s), LATERAL sql_statements(s, 'tsql') f ORDER BY f.ord").collect()
    assert [(r.kind, r.reads) for r in rows] == [("stmt", ["a"]), ("dynamic", [])]
    assert [r.code for r in spark.sql("SELECT code FROM sql_findings('SELECT (', 'tsql')").collect()] == ["unclosed_parenthesis"]
