"""Queries over the given tables, each with SQL that computes the same from the generating columns alone.

The tables hold no SQL text, so procedures, views and snippets are made from their columns; the checking SQL never sees the
text. Documents serve as arbitrary input of the lexer, and the relational tables as graphs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dialect, lexer, references, render
from ..operators import estate as es
from ..operators import layout
from ..operators.flow import Options
from ..sources import catalogue as cat
from ..sources import workspace
from ..sources.corpus import split_objects
from .engine import Estate, analysed, complexity, construct_coverage, corpus_metrics, health
from .shared import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Frame = DataFrame


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> Frame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def made(rows: Frame, text: str, key: str, name: str = "'file'") -> Frame:
    """Files made by an SQL expression over rows; all generating columns are kept."""
    return rows.selectExpr("*", f"cast({key} as string) as file_id", f"cast({name} as string) as name", f"{text} as text")


def units(rows: Frame, text: str, key: str) -> Frame:
    """One unit per row, made by an SQL expression."""
    return rows.selectExpr("*", f"cast({key} as string) as unit_id", f"{text} as sql")


# --- lexer -----------------------------------------------------------------------------------------


@query("SELECT count(*) AS docs, count(*) AS equal FROM documents")
def lex_roundtrip(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    same = F.array_join(F.regexp_extract_all(text, F.lit(lexer.LEXEME), F.lit(0)), "") == text
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("docs"), F.count_if(same).alias("equal"))


_PLAIN = r"[^A-Za-z0-9_@# \n]"
_WORD, _NUMBER = "[A-Za-z_@#][A-Za-z_@#0-9]*", "(0[xX][0-9a-fA-F]*|[0-9]+([eE][0-9]+)?)(_[0-9a-fA-F]+)*"


def _lexed_documents(spark, sf_dir, kind):
    docs = table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("unit_id"), "source", F.regexp_replace(F.coalesce("text", F.lit("")), _PLAIN, " ").alias("sql"))
    found = F.filter(F.regexp_extract_all("sql", F.lit(lexer.LEXEME), F.lit(0)), lambda v: lexer._kind(v) == kind)
    return docs.groupBy("source").agg(F.sum(F.size(found)).alias("tokens"))


_COUNTED = """SELECT source, CAST(sum(len(list_filter(regexp_extract_all(regexp_replace(coalesce(text, ''), '{plain}', ' ', 'g'), '{word}|{number}'), lambda v: {test}))) AS BIGINT) AS tokens
FROM documents GROUP BY source"""


@query(_COUNTED.format(plain=_PLAIN, word=_WORD, number=_NUMBER, test="NOT regexp_matches(v, '^[0-9]')"))
def lex_word_counts(spark, sf_dir):
    return _lexed_documents(spark, sf_dir, "word")


@query(_COUNTED.format(plain=_PLAIN, word=_WORD, number=_NUMBER, test="regexp_matches(v, '^[0-9]')"))
def lex_number_counts(spark, sf_dir):
    return _lexed_documents(spark, sf_dir, "num")


@query("SELECT c_mktsegment, CAST(sum(1 + c_custkey % 4) AS BIGINT) AS literals FROM customer GROUP BY c_mktsegment")
def lex_string_literals(spark, sf_dir):
    rows = units(table(spark, sf_dir, "customer"), "concat('SELECT ', 'N''', replace(c_name, '#', ''''''), '''', repeat(', ''it''''s -- no'' /* '' */', int(c_custkey % 4)))", "c_custkey")
    found = lexer.tokens(rows).filter("kind = 'str'").groupBy("unit_id").agg(F.count("*").alias("n"))
    return rows.join(found, "unit_id").groupBy("c_mktsegment").agg(F.sum("n").alias("literals"))


@query("SELECT p_size % 13 AS depth, count(*) AS units, count(*) * 4 AS tokens FROM part GROUP BY 1")
def lex_comment_nesting(spark, sf_dir):
    """Up to twelve levels: beyond eight, the exact lexer takes over."""
    rows = units(table(spark, sf_dir, "part"), "concat('SELECT 1 ', repeat('/* a ', p_size % 13), 'x', repeat(' */', p_size % 13), ' FROM t')", "p_partkey").withColumn("depth", F.expr("p_size % 13"))
    rows = rows.withColumn("sql", F.expr("case when depth = 0 then 'SELECT 1 FROM t' else sql end"))
    n = lexer.tokens(rows).groupBy("unit_id").agg(F.count("*").alias("n"))
    return rows.join(n, "unit_id").groupBy("depth").agg(F.count("*").alias("units"), F.sum("n").alias("tokens"))


@query("SELECT s_suppkey, CAST(strpos('SELECT ' || s_acctbal || ' FROM ' || s_name, s_name) - 1 AS INT) AS pos FROM supplier")
def lex_offsets(spark, sf_dir):
    rows = units(table(spark, sf_dir, "supplier"), "concat('SELECT ', s_acctbal, ' FROM ', s_name)", "s_suppkey")
    return rows.join(lexer.tokens(rows), "unit_id").filter("v = s_name").select("s_suppkey", "pos")


@query("""SELECT o_orderstatus, count(*) FILTER (o_orderkey % 3 = 1) AS unclosed, count(*) FILTER (o_orderkey % 5 = 2) AS unexpected FROM orders GROUP BY o_orderstatus""")
def paren_balance(spark, sf_dir):
    # an unclosed one would be closed by a later unexpected one, so that one comes first
    text = "concat(if(o_orderkey % 5 = 2, ') ', ''), 'SELECT (a, ', if(o_orderkey % 3 = 1, '(', ''), 'b) FROM f(1)')"
    rows = units(table(spark, sf_dir, "orders"), text, "o_orderkey")
    found = lexer.parenthesis_findings(lexer.tokens(rows)).groupBy("unit_id").agg(F.count_if(F.col("code") == "unclosed_parenthesis").alias("u"), F.count_if(F.col("code") == "unexpected_closing_parenthesis").alias("x"))
    rows = rows.join(found, "unit_id", "left")
    return rows.groupBy("o_orderstatus").agg(F.coalesce(F.sum("u"), F.lit(0)).alias("unclosed"), F.coalesce(F.sum("x"), F.lit(0)).alias("unexpected"))


_OBJECTS = "concat('-- head\\nCREATE OR REPLACE VIEW v', c_custkey, ' AS SELECT 1;\\nGO\\n', if(c_custkey % 2 = 0, 'ALTER PROC p AS SELECT 2;\\n', ''), repeat('CREATE UNIQUE CLUSTERED TRIGGER t ON x AS SELECT 3;\\n', int(c_custkey % 3)))"


@query("""SELECT kind, CAST(sum(n) AS BIGINT) AS objects FROM (
  SELECT 'VIEW' AS kind, 1 AS n FROM customer UNION ALL SELECT 'PROC', 1 FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT 'TRIGGER', c_custkey % 3 FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT 'SCRIPT', 1 FROM supplier) GROUP BY kind""")
def object_split(spark, sf_dir):
    files = made(table(spark, sf_dir, "customer"), _OBJECTS, "c_custkey").select("file_id", "name", "text")
    plain = made(table(spark, sf_dir, "supplier"), "concat('CREATE TABLE t', s_suppkey, ' (a INT)')", "concat('s', s_suppkey)").select("file_id", "name", "text")
    return split_objects(files.unionByName(plain)).groupBy("kind").agg(F.count("*").alias("objects"))


_SNIPPETS = {
    "click": ("DECLARE @x INT; EXEC dbo.p 1", "tsql", 6), "error": ("BEGIN IF a THEN b; ELSEIF c THEN ITERATE l; END IF; END", "db2", 8),
    "purchase": ("CREATE FUNCTION f() AS $$ BEGIN PERFORM g(x::int); END $$", "plpgsql", 9), "signup": ("PRAGMA x; SELECT RAISE(ABORT, 1)", "sqlite", 12), "view": ("SELECT 1", "tsql", 0),
}


@query("SELECT event_type, count(*) AS n, " + ", ".join(f"{agg} AS {name}" for name, agg in (("dialect", "max(CASE event_type " + " ".join(f"WHEN '{k}' THEN '{d}'" for k, (_, d, _) in _SNIPPETS.items()) + " END)"), ("score", "max(CASE event_type " + " ".join(f"WHEN '{k}' THEN {s}" for k, (_, _, s) in _SNIPPETS.items()) + " END)"), ("confident", "bool_and(event_type <> 'view')"), ("certainty", "max(round(least(1.0, CASE event_type " + " ".join(f"WHEN '{k}' THEN {s}" for k, (_, _, s) in _SNIPPETS.items()) + " END / 7), 6))"))) + " FROM events GROUP BY event_type")
def dialect_scores(spark, sf_dir):
    text = "case event_type " + " ".join(f"when '{k}' then '{t}'" for k, (t, _, _) in _SNIPPETS.items()) + " end"
    rows = dialect.detect(table(spark, sf_dir, "events").selectExpr("event_type", f"{text} as sql"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.max("dialect").alias("dialect"), F.max("score").alias("score"), F.bool_and("confident").alias("confident"), F.max(F.round("certainty", 6)).alias("certainty"))


# --- references by windows ---------------------------------------------------------------------------


def _refs(spark, sf_dir, text):
    rows = units(table(spark, sf_dir, "orders"), text, "o_orderkey")
    return references.source_frame(lexer.tokens(rows), ["unit_id"]).groupBy("name", "resolution").agg(F.count("*").alias("refs"))


_SRC = "'src_' || (o_custkey % 7)"


@query(f"""SELECT name, 'exact' AS resolution, count(*) AS refs FROM (
  SELECT {_SRC} AS name FROM orders UNION ALL SELECT 'dbo.dim_' || o_orderstatus FROM orders UNION ALL SELECT 'inner_' || (o_orderkey % 3) FROM orders) GROUP BY 1, 2""")
def refs_from_join(spark, sf_dir):
    return _refs(spark, sf_dir, "concat('SELECT a FROM src_', o_custkey % 7, ' s LEFT JOIN dbo.dim_', o_orderstatus, ' d ON s.k = d.k WHERE EXISTS (SELECT 1 FROM inner_', o_orderkey % 3, ')')")


@query(f"""SELECT name, 'exact' AS resolution, count(*) AS refs FROM (
  SELECT {_SRC} AS name FROM orders UNION ALL SELECT 'b_' || o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'c' FROM orders) GROUP BY 1, 2""")
def refs_comma(spark, sf_dir):
    return _refs(spark, sf_dir, "concat('SELECT f(x, y) FROM src_', o_custkey % 7, if(o_orderkey % 2 = 0, concat(' AS a, b_', o_orderstatus), ''), ', c WHERE z IN (1, d) ORDER BY p, q')")


@query("""SELECT name, resolution, count(*) AS refs FROM (
  SELECT 'u_' || o_orderstatus AS name, 'exact' AS resolution FROM orders UNION ALL SELECT 'fn_' || (o_orderkey % 4), 'heuristic' FROM orders
  UNION ALL SELECT 'srv.db.t_' || o_orderstatus, 'heuristic' FROM orders) GROUP BY 1, 2""")
def refs_using_apply(spark, sf_dir):
    return _refs(spark, sf_dir, "concat('MERGE INTO t USING u_', o_orderstatus, ' ON a = b WHEN MATCHED THEN DELETE; SELECT 1 FROM srv.db.t_', o_orderstatus, ' CROSS APPLY fn_', o_orderkey % 4, '(x)')")


@query("""SELECT name, resolution, count(*) AS refs FROM (
  SELECT CASE o_orderkey % 4 WHEN 0 THEN 'UNNEST' WHEN 1 THEN 'XMLTABLE' WHEN 2 THEN 'json_table' ELSE 'x.unnest' END AS name,
         CASE WHEN o_orderkey % 4 = 3 THEN 'exact' ELSE 'opaque' END AS resolution FROM orders) GROUP BY 1, 2""")
def refs_tabular_opaque(spark, sf_dir):
    return _refs(spark, sf_dir, "concat('SELECT * FROM ', element_at(array('UNNEST', 'XMLTABLE', 'json_table', 'x.unnest'), int(o_orderkey % 4) + 1), '(a) WHERE 1 = 1')")


@query("SELECT 'a_' || o_orderstatus AS name, 'exact' AS resolution, count(*) AS refs FROM orders GROUP BY 1, 2")
def refs_quirk_nested_comma(spark, sf_dir):
    """After a derived table, the outer list is not taken up again."""
    return _refs(spark, sf_dir, "concat('SELECT 1 FROM (SELECT 1 FROM a_', o_orderstatus, ') x, missed')")


@query("SELECT name, 'exact' AS resolution, count(*) AS refs FROM (SELECT 'a' AS name FROM orders UNION ALL SELECT 'b_' || o_orderstatus FROM orders) GROUP BY 1, 2")
def refs_quirk_on_comma(spark, sf_dir):
    """ON ends a list of sources."""
    return _refs(spark, sf_dir, "concat('SELECT 1 FROM a JOIN b_', o_orderstatus, ' ON a.i = b.i, missed')")


# --- statements ----------------------------------------------------------------------------------------


def _customers(spark, sf_dir, text, **options) -> tuple[Frame, Frame]:
    rows = units(table(spark, sf_dir, "customer"), text, "c_custkey")
    return rows, analysed(rows, **options)


def _procedure(body: str) -> str:
    return f"concat('CREATE PROCEDURE dbo.proc_', c_custkey, ' @a INT AS\\nBEGIN\\n', {body}, '\\nEND')"


@query("SELECT c_mktsegment, CAST(sum(1 + c_custkey % 5) AS BIGINT) AS statements FROM customer GROUP BY 1")
def stmt_split_semicolon(spark, sf_dir):
    rows, got = _customers(spark, sf_dir, "concat(repeat('SELECT (SELECT 1 FROM a); ', int(c_custkey % 5)), 'UPDATE t SET a = CASE WHEN b = 1 THEN 2 ELSE 3 END WHERE c = 1')", dialect="tsql")
    return rows.join(got, "unit_id").groupBy("c_mktsegment").agg(F.sum(F.size("statements")).alias("statements"))


@query("SELECT c_mktsegment, CAST(sum(4 + c_custkey % 5) AS BIGINT) AS statements FROM customer GROUP BY 1")
def stmt_split_implicit(spark, sf_dir):
    body = "repeat('SELECT a FROM b WHERE c = 1 ', int(c_custkey % 5)), 'INSERT INTO t SELECT x FROM y UNION ALL SELECT z FROM w UPDATE t SET a = 1 FROM b DECLARE @v INT EXEC dbo.q @v'"
    rows, got = _customers(spark, sf_dir, _procedure(body), dialect="tsql")
    return rows.join(got, "unit_id").groupBy("c_mktsegment").agg(F.sum(F.size("statements")).alias("statements"))


_KINDS = (("SELECT 1", "stmt"), ("INSERT INTO t VALUES (1)", "io"), ("EXEC dbo.p", "call"), ("BEGIN TRAN", "tran"), ("FETCH NEXT FROM c", "cursor"), ("RAISERROR(1, 10, 1)", "notice"), ("EXEC(@s)", "opaque"), ("THROW", "err"))


@query("SELECT cls, CAST(sum(n) AS BIGINT) AS nodes FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS cls, count(*) AS n FROM customer WHERE c_custkey % {len(_KINDS)} = {i}" for i, (_, c) in enumerate(_KINDS)) + " UNION ALL SELECT 'start', 2 * count(*) FROM customer) GROUP BY cls HAVING sum(n) > 0")
def stmt_kinds(spark, sf_dir):
    _, got = _customers(spark, sf_dir, "element_at(array(" + ", ".join(f"'{t}'" for t, _ in _KINDS) + f"), int(c_custkey % {len(_KINDS)}) + 1)", dialect="tsql", mode="flow")
    return got.select(F.explode("nodes").alias("n")).groupBy(F.col("n.cls").alias("cls")).agg(F.count("*").alias("nodes"))


@query("""SELECT name, CAST(count(*) AS BIGINT) AS objects FROM (
  SELECT 'dbo.a_' || (c_custkey % 3) AS name FROM customer UNION ALL SELECT '#t_' || (c_custkey % 2) FROM customer UNION ALL SELECT 'm' FROM customer
  UNION ALL SELECT 'made' FROM customer WHERE c_custkey % 2 = 0) GROUP BY name""")
def facts_writes(spark, sf_dir):
    body = "'INSERT INTO dbo.a_', c_custkey % 3, ' SELECT 1; SELECT x INTO #t_', c_custkey % 2, ' FROM y; SELECT @v = 1; MERGE INTO m USING s ON 1 = 1 WHEN MATCHED THEN DELETE; DELETE FROM M; UPDATE TOP (5) m SET a = 1; ', if(c_custkey % 2 = 0, 'CREATE TABLE made (a INT)', 'SELECT a INTO @x FROM b')"
    _, got = _customers(spark, sf_dir, _procedure(body), dialect="tsql", columns=("writes",))
    return got.select(F.explode("writes").alias("name")).groupBy("name").agg(F.count("*").alias("objects"))


@query("SELECT name, count(*) AS objects FROM (SELECT 'dbo.p_' || (c_custkey % 4) AS name FROM customer UNION ALL SELECT 'q' FROM customer WHERE c_custkey % 3 > 0) GROUP BY name")
def facts_calls(spark, sf_dir):
    body = "'EXEC @rc = dbo.p_', c_custkey % 4, ' 1; EXEC DBO.P_', c_custkey % 4, '; ', if(c_custkey % 3 > 0, 'EXECUTE q;', 'EXEC sp_executesql @s;')"
    _, got = _customers(spark, sf_dir, _procedure(body), dialect="tsql")
    return got.select(F.explode("calls").alias("name")).groupBy("name").agg(F.count("*").alias("objects"))


@query("SELECT c_mktsegment, CAST(sum(1 + c_custkey % 3) AS BIGINT) AS result_sets FROM customer GROUP BY 1")
def facts_resultsets(spark, sf_dir):
    rows, got = _customers(spark, sf_dir, _procedure("'SELECT 1; SELECT a INTO #x FROM b; ', repeat('SELECT c FROM d; ', int(c_custkey % 3))"), dialect="tsql")
    return rows.join(got, "unit_id").groupBy("c_mktsegment").agg(F.sum(F.size(F.filter("statements", lambda s: s["result_set"]))).alias("result_sets"))


@query("SELECT p_type, min_by(n, p_partkey) AS name FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand) ELSE p_brand END AS n FROM part) GROUP BY p_type, upper(p_brand)")
def distinct_names_ci(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_type", "p_partkey", "if(p_partkey % 2 = 0, lower(p_brand), p_brand) as name")
    return es.distinct_names(rows, ["p_type"], "name", "p_partkey").select("p_type", "name")


# --- queries and CTEs -------------------------------------------------------------------------------------

_CHAIN = "concat(if(p_size % 5 = 0, '', 'WITH '), array_join(transform(sequence(1, greatest(p_size % 5, 1)), i -> concat('c', i, ' AS (SELECT * FROM ', if(i = 1, concat('base_', p_partkey % 9), concat('c', i - 1)), ')')), ', '), ' SELECT * FROM c', p_size % 5, ' JOIN dbo.dim ON 1 = 1 WHERE x = 1')"
_CHAIN = f"if(p_size % 5 = 0, concat('SELECT * FROM base_', p_partkey % 9, ' JOIN dbo.dim ON 1 = 1 WHERE x = 1'), {_CHAIN})"


def _parts(spark, sf_dir, text=_CHAIN, **options) -> tuple[Frame, Frame]:
    rows = units(table(spark, sf_dir, "part"), text, "p_partkey")
    return rows, analysed(rows, dialect="sqlite", **options)


@query("SELECT p_size % 5 AS chain, count(*) AS units, count(*) * (p_size % 5) AS ctes, CAST(sum(1 + p_size % 5) AS BIGINT) AS depth, CAST(2 * count(*) AS BIGINT) AS tables FROM part GROUP BY 1")
def cte_split(spark, sf_dir):
    rows, got = _parts(spark, sf_dir, columns=("stats",))
    s = F.col("stats")
    return rows.join(got, "unit_id").groupBy(F.expr("p_size % 5").alias("chain")).agg(F.count("*").alias("units"), F.sum(s["ctes"]).alias("ctes"), F.sum(s["depth"]).alias("depth"), F.sum(s["tables"]).alias("tables"))


@query("SELECT count(*) FILTER (p_size % 3 = 0) AS cte_recursive, count(*) FILTER (p_size % 3 = 1) AS cte_recursion_approx FROM part")
def cte_recursive(spark, sf_dir):
    text = "concat('WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM ', case p_size % 3 when 0 then 'r' when 1 then 'R, generate_series(1, 2)' else 'other' end, ') SELECT * FROM r')"
    _, got = _parts(spark, sf_dir, text)
    codes = got.select(F.explode("findings.code").alias("code"))
    return codes.agg(*(F.count_if(F.col("code") == c).alias(c) for c in ("cte_recursive", "cte_recursion_approx")))


@query("""SELECT CAST(sum(1 + p_size % 3) AS BIGINT) AS joins, CAST(sum(p_size % 2) AS BIGINT) AS unions, CAST(sum(p_size % 4) AS BIGINT) AS subs, CAST(sum(1 + p_size % 3 + p_size % 2 + p_size % 4) AS BIGINT) AS parts FROM part""")
def query_counters(spark, sf_dir):
    text = "concat('SELECT 1 FROM a JOIN b ON 1 = 1', repeat(' LEFT JOIN c ON 1 = 1', p_size % 3), repeat(' UNION ALL SELECT 2 FROM d', p_size % 2), ' WHERE 1 = 1', repeat(' AND EXISTS (SELECT 1 FROM e)', p_size % 4))"
    _, got = _parts(spark, sf_dir, text)
    return got.agg(*(F.sum(F.col("stats")[k]).alias(k) for k in ("joins", "unions", "subs", "parts")))


@query("""SELECT src, dst, count(*) AS edges FROM (
  SELECT 'base_' || (p_partkey % 9) AS src, CASE WHEN p_size % 5 = 0 THEN 'Final SELECT' ELSE 'c1' END AS dst FROM part
  UNION ALL SELECT 'dbo.dim', 'Final SELECT' FROM part
  UNION ALL SELECT 'c' || i, CASE WHEN i = p_size % 5 THEN 'Final SELECT' ELSE 'c' || (i + 1) END FROM part, range(1, 5) r(i) WHERE i <= p_size % 5) GROUP BY 1, 2""")
def query_edges(spark, sf_dir):
    _, got = _parts(spark, sf_dir, columns=("nodes", "edges"))
    named = F.map_from_arrays(F.col("nodes.id"), F.transform("nodes", lambda n: F.get(F.split(n["text"], "\n"), F.lit(0))))
    e = got.select(F.explode("edges").alias("e"), named.alias("m")).select(F.col("m")[F.col("e.src")].alias("src"), F.col("m")[F.col("e.dst")].alias("dst"))
    return e.groupBy("src", "dst").agg(F.count("*").alias("edges"))


@query("SELECT count(*) AS units, CAST(sum(1 + p_size % 5) AS BIGINT) AS depth, CAST(max(1 + p_size % 5) AS INT) AS deepest, CAST(sum(2 * (p_size % 5) * 0 + 1) AS BIGINT) AS operations FROM part")
def query_chain_depth(spark, sf_dir):
    _, got = _parts(spark, sf_dir, mode="query", columns=("stats",))
    s = F.col("stats")
    return got.agg(F.count("*").alias("units"), F.sum(s["depth"]).alias("depth"), F.max(s["depth"]).alias("deepest"), F.sum(s["parts"] - s["ctes"] - s["joins"]).alias("operations"))


# --- estates ---------------------------------------------------------------------------------------------

_ESTATE = _procedure("'SELECT * FROM dbo.src_', c_nationkey, ' s JOIN dbo.dim d ON 1 = 1; INSERT INTO dbo.out_', c_custkey % 5, ' SELECT 1 FROM #tmp; EXEC dbo.proc_', c_custkey + 1, '; ', if(c_custkey % 6 = 0, 'EXEC(@s);', '')")


def _estate(spark, sf_dir) -> Estate:
    columns = ("name", "header_kind", "reads", "writes", "calls", "confidence", "tokens_total", "tokens_consumed", "findings")
    return Estate(made(table(spark, sf_dir, "customer"), _ESTATE, "c_custkey").select("file_id", "name", "text"), dialect="tsql", columns=columns)


def _stored_estate(spark, sf_dir) -> Estate:
    """For what reads objects and references several times: parsed once."""
    return _estate(spark, sf_dir).stored(f"{shared_folder(spark)}/estate-{uuid.uuid4().hex}")


_ESTATE_REFS = """SELECT c_custkey, 'reads' AS role, 'dbo.src_' || c_nationkey AS name FROM customer UNION ALL SELECT c_custkey, 'reads', 'dbo.dim' FROM customer
  UNION ALL SELECT c_custkey, 'reads', '#tmp' FROM customer UNION ALL SELECT c_custkey, 'writes', 'dbo.out_' || (c_custkey % 5) FROM customer
  UNION ALL SELECT c_custkey, 'calls', 'dbo.proc_' || (c_custkey + 1) FROM customer"""


@query(f"SELECT name, role, count(*) AS objects FROM ({_ESTATE_REFS}) GROUP BY name, role")
def estate_edges(spark, sf_dir):
    return _estate(spark, sf_dir).references.groupBy("name", "role").agg(F.count("*").alias("objects"))


@query(f"""WITH r AS ({_ESTATE_REFS}) SELECT (SELECT count(*) FROM customer) AS objects, count(*) FILTER (role = 'reads') AS reads, count(*) FILTER (role = 'writes') AS writes, count(*) FILTER (role = 'calls') AS calls,
  (SELECT count(*) FROM (SELECT DISTINCT role, name FROM r) x WHERE name NOT IN (SELECT 'dbo.proc_' || c_custkey FROM customer)) AS external FROM r""")
def estate_stats(spark, sf_dir):
    e = _stored_estate(spark, sf_dir)
    return es.estate_stats(*es.dependency_graph(e.objects, e.references)).select("objects", "reads", "writes", "calls", "external")


@query(f"""WITH r AS ({_ESTATE_REFS}) SELECT kind, style, count(*) AS edges, count(*) FILTER (inside) AS inside FROM (
  SELECT CASE role WHEN 'calls' THEN 'call' WHEN 'writes' THEN 'data' ELSE 'dependency' END AS kind, CASE role WHEN 'writes' THEN 'dotted' ELSE 'solid' END AS style,
         name IN (SELECT 'dbo.proc_' || c_custkey FROM customer) AS inside FROM r) GROUP BY kind, style""")
def estate_graph(spark, sf_dir):
    e = _stored_estate(spark, sf_dir)
    _, edges = es.dependency_graph(e.objects, e.references)
    return edges.groupBy("kind", "style").agg(F.count("*").alias("edges"), F.count_if(F.col("dst").startswith("o:")).alias("inside"))


@query("SELECT round(min(CASE WHEN c_custkey % 6 = 0 THEN (29 + 0.4 * 4) / 33 ELSE 1.0 END), 6) AS confidence, 1.0 AS coverage, count(*) FILTER (c_custkey % 6 = 0) AS diagnostics FROM customer")
def estate_health(spark, sf_dir):
    return health(_estate(spark, sf_dir).rows).select(F.round("confidence", 6).alias("confidence"), "coverage", "diagnostics")


def _relations(spark, sf_dir) -> tuple[Frame, Frame]:
    """Suppliers read their nation, nations write their region, regions call region 0."""
    none = "cast(null as string)"
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    nodes = s.selectExpr("concat('s', s_suppkey) as id", "s_name as text", "'source' as provenance", f"{none} as object_id").unionByName(n.selectExpr("concat('n', n_nationkey) as id", "n_name as text", "'external' as provenance", "n_name as object_id")).unionByName(r.selectExpr("concat('r', r_regionkey) as id", "r_name as text", "if(r_regionkey % 2 = 0, 'synthetic', 'source') as provenance", f"{none} as object_id"))
    edges = s.selectExpr("concat('s', s_suppkey) as src", "concat('n', s_nationkey) as dst", "'dependency' as kind").unionByName(n.selectExpr("concat('n', n_nationkey) as src", "concat('r', n_regionkey) as dst", "'data' as kind")).unionByName(r.filter("r_regionkey > 0").selectExpr("concat('r', r_regionkey) as src", "'r0' as dst", "'call' as kind"))
    return nodes, edges


@query("""SELECT (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region WHERE r_regionkey % 2 = 1) AS nodes,
  (SELECT count(*) FROM supplier) AS dependency, 0 AS data, (SELECT count(*) FROM region WHERE false) AS call""")
def dep_filter_kind(spark, sf_dir):
    nodes, edges = es.filtered(*_relations(spark, sf_dir), writes=False, temp=False)
    kinds = edges.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("dependency", "data", "call"))).withColumn("one", F.lit(1))
    return nodes.agg(F.count("*").alias("nodes")).withColumn("one", F.lit(1)).join(kinds, "one").select("nodes", "dependency", F.col("data").cast("int").alias("data"), "call")


@query("""WITH hit AS (SELECT * FROM nation WHERE upper(n_name) LIKE '%1%') SELECT (SELECT count(*) FROM hit) + (SELECT count(*) FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM hit) OR upper(s_name) LIKE '%1%')
  + (SELECT count(*) FROM nation WHERE upper(n_name) NOT LIKE '%1%' AND n_nationkey IN (SELECT s_nationkey FROM supplier WHERE upper(s_name) LIKE '%1%'))
  + (SELECT count(*) FROM region WHERE upper(r_name) LIKE '%1%' OR r_regionkey IN (SELECT n_regionkey FROM hit) OR r_regionkey IN (SELECT CASE WHEN r_regionkey > 0 THEN 0 END FROM region WHERE upper(r_name) LIKE '%1%') OR (r_regionkey > 0 AND EXISTS (SELECT 1 FROM region WHERE r_regionkey = 0 AND upper(r_name) LIKE '%1%')))
  + (SELECT count(*) FROM nation WHERE upper(n_name) NOT LIKE '%1%' AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE upper(s_name) LIKE '%1%') AND n_regionkey IN (SELECT r_regionkey FROM region WHERE upper(r_name) LIKE '%1%')) AS nodes""")
def dep_filter_focus(spark, sf_dir):
    nodes, _ = es.filtered(*_relations(spark, sf_dir), focus=" 1 ")
    return nodes.agg(F.count("*").alias("nodes"))


# --- catalogue ----------------------------------------------------------------------------------------------


def _catalogue(spark, sf_dir) -> cat.Catalogue:
    """Nations as tables: the reference tables are 25 and 5 rows at any scale. Region names are synonyms of the first nation of each."""
    names = [r.n_name for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect()]
    lines = "\n".join(["# nations", *(f"dbo.[{n}] TABLE, syn.{n}" for n in names), f"dbo.{names[3]} VIEW", f"dbo.other PROC syn.{names[4]}", "COL dbo.other.id"])
    return cat.parse_catalogue(lines)


@query("""WITH n AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM nation), refs AS (
  SELECT s_suppkey, n.n_name, n.k, s_suppkey % 4 AS form FROM supplier JOIN n ON s_nationkey = n_nationkey)
SELECT s_suppkey, CASE WHEN form = 3 THEN 'external' WHEN form = 2 THEN CASE WHEN k = 4 THEN 'conflict' ELSE 'verified' END WHEN k = 3 THEN 'conflict' ELSE 'verified' END AS resolution,
  CASE WHEN form = 3 OR (form = 2 AND k = 4) OR (form < 2 AND k = 3) THEN NULL ELSE 'dbo.[' || n_name || ']' END AS canonical FROM refs""")
def catalogue_resolve(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey"))
    rows = rows.selectExpr("s_suppkey", "case s_suppkey % 4 when 0 then concat('dbo.', n_name) when 1 then concat('DBO.\"', lower(n_name), '\"') when 2 then concat('syn.', n_name) else concat('x.dbo.', n_name) end as name")
    return cat.resolved(rows, cat.index_frame(spark, _catalogue(spark, sf_dir))).select("s_suppkey", "resolution", "canonical")


@query("SELECT upper('dbo.' || n_name) AS norm FROM nation WHERE n_nationkey = (SELECT n_nationkey FROM nation ORDER BY 1 LIMIT 1 OFFSET 3) UNION ALL SELECT upper('syn.' || n_name) FROM nation WHERE n_nationkey = (SELECT n_nationkey FROM nation ORDER BY 1 LIMIT 1 OFFSET 4)")
def catalogue_conflicts(spark, sf_dir):
    return cat.index_frame(spark, _catalogue(spark, sf_dir)).filter("resolution = 'conflict'").select("norm")


@query("SELECT s_suppkey AS ref_id, 'dbo.[' || n_name || ']' AS candidate FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 0")
def catalogue_suffix(spark, sf_dir):
    objects = table(spark, sf_dir, "nation").selectExpr("upper(concat('dbo.', n_name)) as norm", "n_nationkey as ord", "concat('dbo.[', n_name, ']') as canonical")
    refs = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey")).selectExpr("s_suppkey as ref_id", "concat(if(s_suppkey % 2 = 0, 'srv.db.dbo.', 'dbo.'), n_name) as name")
    return cat.suffix_matches(refs, objects).select("ref_id", "candidate")


# --- control flow -------------------------------------------------------------------------------------------

_KNOBS = _procedure(
    "'SET NOCOUNT ON;', repeat(' IF @a > 1 UPDATE dbo.t SET x = 1;', int(c_custkey % 4)), repeat(' WHILE @a < 3 SET @a = @a + 1;', int(c_custkey % 3)), "
    "if(c_custkey % 2 = 1, ' BEGIN TRY INSERT INTO dbo.l SELECT 1 FROM dbo.s; END TRY BEGIN CATCH THROW; END CATCH;', ''), if(c_custkey % 5 = 0, ' EXEC dbo.p;', ''), if(c_custkey % 6 = 0, ' EXEC(@s);', ''), if(c_custkey % 7 = 0, concat(' GOTO lost_', c_custkey, ';'), ''), ' RETURN 0;'"
)


def _knobs(spark, sf_dir, **options) -> tuple[Frame, Frame]:
    return _customers(spark, sf_dir, _KNOBS, dialect="tsql", mode="flow", **options)


@query("""SELECT CAST(sum(1 + c_custkey % 4 + c_custkey % 3 + c_custkey % 2 + CAST(c_custkey % 5 = 0 AS INT) + CAST(c_custkey % 6 = 0 AS INT)) AS BIGINT) AS stmt, CAST(sum(c_custkey % 4) AS BIGINT) AS branch, CAST(sum(c_custkey % 3) AS BIGINT) AS loop,
  CAST(sum(c_custkey % 2) AS BIGINT) AS cat, CAST(sum(1 + c_custkey % 2) AS BIGINT) AS exit, CAST(sum(CAST(c_custkey % 6 = 0 AS INT)) AS BIGINT) AS opaque FROM customer""")
def cfg_counts(spark, sf_dir):
    _, got = _knobs(spark, sf_dir, columns=("flow_stats",))
    return got.agg(*(F.sum(F.col("flow_stats")[k]).alias(k) for k in ("stmt", "branch", "loop", "cat", "exit", "opaque")))


@query("SELECT 1 + c_custkey % 4 + c_custkey % 3 + c_custkey % 2 AS cc, count(*) AS units, CAST(CASE WHEN cc > 5 THEN 2 ELSE 1 END AS INT) AS band FROM customer GROUP BY 1")
def cyclomatic(spark, sf_dir):
    _, got = _knobs(spark, sf_dir, columns=("mode", "stats"))
    return complexity(got).groupBy(F.col("value").cast("long").alias("cc"), "band").agg(F.count("*").alias("units")).select("cc", "units", "band")


@query("SELECT count(*) AS exits, CAST(count(*) + sum(c_custkey % 2) AS BIGINT) AS terminals FROM customer")
def cfg_exits(spark, sf_dir):
    """Every RETURN has a dotted edge to the end; terminals are RETURN and THROW."""
    _, got = _knobs(spark, sf_dir, columns=("nodes", "edges"))
    ends = got.select(F.filter("nodes", lambda n: n["cls"].isin("ret", "err")).alias("t"), F.get(F.filter("nodes", lambda n: (n["cls"] == "start") & (n["text"] == "End")), F.lit(0))["id"].alias("end"), "edges")
    hit = F.size(F.filter("edges", lambda e: (e["dst"] == F.col("end")) & (e["style"] == "dotted")))
    return ends.agg(F.sum(hit).alias("exits"), F.sum(F.size("t")).alias("terminals"))


@query("SELECT c_custkey, 'lost_' || c_custkey AS label FROM customer WHERE c_custkey % 7 = 0")
def goto_unresolved(spark, sf_dir):
    """By anti join over the flattened tree."""
    rows, got = _knobs(spark, sf_dir, columns=("ast",))
    ast = got.select("unit_id", F.explode("ast").alias("x")).select("unit_id", "x.*")
    return es.unresolved_gotos(ast).join(rows, "unit_id").select("c_custkey", "label")


@query("SELECT count(*) FILTER (c_custkey % 2 = 0) AS lost FROM customer")
def break_unresolved(spark, sf_dir):
    text = "concat('CREATE FUNCTION f() RETURNS int AS $$ BEGIN <<a>> LOOP EXIT ', if(c_custkey % 2 = 0, 'b', 'A'), '; END LOOP; END $$ LANGUAGE plpgsql')"
    _, got = _customers(spark, sf_dir, text, dialect="plpgsql")
    return es.unresolved_breaks(got.select("unit_id", F.explode("ast").alias("x")).select("unit_id", "x.*")).agg(F.count("*").alias("lost"))


@query("SELECT c_custkey, '#t' AS label, CAST(1 + c_custkey % 3 AS BIGINT) AS edges FROM customer")
def temp_flow_linear(spark, sf_dir):
    rows, got = _customers(spark, sf_dir, _procedure("'SELECT a INTO #t FROM b;', repeat(' UPDATE #t SET a = 1;', int(c_custkey % 3)), ' SELECT * FROM #t;'"), dialect="tsql", mode="flow", options=Options(group=False))
    e = rows.join(got, "unit_id").select("c_custkey", F.explode("edges").alias("e")).filter("e.kind = 'data'")
    return e.groupBy("c_custkey", F.col("e.label").alias("label")).agg(F.count("*").alias("edges"))


@query("SELECT count(*) FILTER (c_custkey % 2 = 0) AS edges, count(*) FILTER (c_custkey % 2 = 1) AS ambiguous FROM customer")
def temp_flow_ambiguous(spark, sf_dir):
    _, got = _customers(spark, sf_dir, _procedure("if(c_custkey % 2 = 1, 'IF @a = 1 ', ''), 'SELECT a INTO #t FROM b; SELECT 1 FROM #t; '"), dialect="tsql", mode="flow", options=Options(group=False))
    return got.agg(F.sum(F.size(F.filter("edges", lambda e: e["kind"] == "data"))).alias("edges"), F.sum(F.size(F.filter("findings", lambda f: f["code"] == "temp_flow_ambiguous"))).alias("ambiguous"))


@query("SELECT CAST(sum(2 + c_custkey % 3) AS BIGINT) AS wires FROM customer")
def handler_wires(spark, sf_dir):
    """With fan-in, every statement of a TRY body may raise: one dotted wire each to the CATCH."""
    _, got = _customers(spark, sf_dir, _procedure("'BEGIN TRY INSERT INTO a SELECT 1; ', repeat('UPDATE b SET c = 1; ', int(c_custkey % 3)), 'EXEC p; END TRY BEGIN CATCH SELECT 1; END CATCH'"), dialect="tsql", mode="flow", options=Options(fan_in=True))
    return got.agg(F.sum(F.size(F.filter("edges", lambda e: e["kind"] == "exception"))).alias("wires"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'COMMIT — invalid: no active transaction' WHEN 1 THEN 'ROLLBACK — invalid: no active transaction' ELSE 'none' END AS text FROM customer")
def tx_invalid_actions(spark, sf_dir):
    body = "'IF @@TRANCOUNT = 0 BEGIN ', case c_custkey % 4 when 0 then 'COMMIT' when 1 then 'ROLLBACK' when 2 then 'BEGIN TRAN; COMMIT' else 'BEGIN TRAN; SAVE TRAN s; ROLLBACK TRAN s' end, '; END'"
    rows, got = _customers(spark, sf_dir, _procedure(body), dialect="tsql", mode="flow")
    bad = F.get(F.filter("nodes", lambda n: n["cls"] == "err"), F.lit(0))["text"]
    return rows.join(got, "unit_id").select("c_custkey", F.coalesce(bad, F.lit("none")).alias("text"))


_PG = (("PROCEDURE", "COMMIT", "plpgsql_transaction_context_required"), ("FUNCTION", "COMMIT", "plpgsql_transaction_context"), ("PROCEDURE", "SAVEPOINT s", "plpgsql_savepoint_unsupported"), ("PROCEDURE", "START TRANSACTION", "plpgsql_transaction_start_unsupported"), ("PROCEDURE", "BEGIN ROLLBACK; EXCEPTION WHEN OTHERS THEN NULL; END", "plpgsql_transaction_in_exception_scope"))


@query("SELECT code, CAST(sum(n) AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS code, count(*) AS n FROM customer WHERE c_custkey % 5 = {i}" for i, (_, _, c) in enumerate(_PG)) + ") GROUP BY code HAVING sum(n) > 0")
def pg_tx_rules(spark, sf_dir):
    text = "case c_custkey % 5 " + " ".join(f"when {i} then 'CREATE {k} f() AS $b$ BEGIN {s}; END $b$ LANGUAGE plpgsql'" for i, (k, s, _) in enumerate(_PG)) + " end"
    _, got = _customers(spark, sf_dir, text, dialect="plpgsql")
    return got.select(F.explode("findings.code").alias("code")).filter("code like 'plpgsql%'").groupBy("code").agg(F.count("*").alias("n"))


# --- findings and scores -------------------------------------------------------------------------------------

_BAD = (("SELECT 'open", "unterminated_string"), ("SELECT [open", "unterminated_identifier"), ("SELECT 1 /* /* */", "unterminated_comment"), ("SELECT (1", "unclosed_parenthesis"), ("SELECT 1)", "unexpected_closing_parenthesis"), ("BEGIN SELECT 1;", "missing_end"), ("SELECT 1; END", "unexpected_end"), ("EXEC(@s)", "dynamic_sql"), ("SELECT * FROM UNNEST(a)", "source_opaque"), ("SELECT * FROM t CROSS APPLY f(1)", "apply_heuristic"))


@query("SELECT code, CAST(sum(n) AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS code, count(*) AS n FROM part WHERE p_partkey % {len(_BAD)} = {i}" for i, (_, c) in enumerate(_BAD)) + f" UNION ALL SELECT 'unconsumed_input', count(*) FROM part WHERE p_partkey % {len(_BAD)} = 6) GROUP BY code HAVING sum(n) > 0")
def diag_counts(spark, sf_dir):
    text = f"case p_partkey % {len(_BAD)} " + " ".join("when {} then '{}'".format(i, t.replace("'", "''")) for i, (t, _) in enumerate(_BAD)) + " end"
    rows = units(table(spark, sf_dir, "part"), text, "p_partkey")
    return analysed(rows, dialect="tsql").select(F.explode("findings.code").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, round((4.0 * (1 + c_custkey % 3) + 0.4 * 5 * (c_custkey % 2)) / (4 * (1 + c_custkey % 3) + 5 * (c_custkey % 2)), 6) AS confidence,
  CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 2 AND false THEN 'high' WHEN (4.0 * (1 + c_custkey % 3) + 2.0) / (4 * (1 + c_custkey % 3) + 5) >= 0.85 THEN 'high' WHEN (4.0 * (1 + c_custkey % 3) + 2.0) / (4 * (1 + c_custkey % 3) + 5) >= 0.6 THEN 'medium' ELSE 'low' END AS band FROM customer""")
def confidence_scores(spark, sf_dir):
    """Statements of four tokens, and a dynamic one of five at 0.4."""
    from .engine import confidence_band

    rows, got = _customers(spark, sf_dir, "concat(repeat('SELECT a FROM b; ', int(1 + c_custkey % 3)), repeat('EXEC (@s + 1)', 0), if(c_custkey % 2 = 1, 'EXEC sp_executesql @s, @t', ''))", dialect="tsql")
    return rows.join(got, "unit_id").select("c_custkey", F.round("confidence", 6).alias("confidence"), confidence_band().alias("band"))


@query("""SELECT CAST(sum(5 * (1 + c_custkey % 3) + 10 * (c_custkey % 2)) AS BIGINT) AS total, CAST(sum(4 * (1 + c_custkey % 3) + 7 * (c_custkey % 2)) AS BIGINT) AS resolved, 0 AS opaque, CAST(sum(1 + c_custkey % 3) AS BIGINT) AS semicolons, CAST(sum(2 * (c_custkey % 2)) AS BIGINT) AS keywords, CAST(sum(c_custkey % 2) AS BIGINT) AS unresolved FROM customer""")
def attribution_totals(spark, sf_dir):
    _, got = _customers(spark, sf_dir, "concat(repeat('SELECT a FROM b; ', int(1 + c_custkey % 3)), if(c_custkey % 2 = 1, 'WHILE x < 1 BEGIN SELECT c FROM d END', ''))", dialect="tsql", mode="flow")
    s = {k: F.sum(F.col("attribution")[k]) for k in ("total", "resolved", "opaque", "semicolons", "keywords", "unresolved")}
    # the WHILE itself belongs to no statement
    got = got.agg(*(v.alias(k) for k, v in s.items()))
    return got.select("total", "resolved", F.col("opaque").cast("int").alias("opaque"), "semicolons", "keywords", "unresolved")


@query("""SELECT kind, CAST(sum(n) AS BIGINT) AS detected, CAST(sum(CASE WHEN kind = 'dynamic' THEN 0 ELSE n END) AS BIGINT) AS resolved, CAST(sum(CASE WHEN kind = 'dynamic' THEN n ELSE 0 END) AS BIGINT) AS opaque FROM (
  SELECT 'branch' AS kind, c_custkey % 4 AS n FROM customer UNION ALL SELECT 'loop', c_custkey % 3 FROM customer UNION ALL SELECT 'handler', c_custkey % 2 FROM customer
  UNION ALL SELECT 'dynamic', CAST(c_custkey % 6 = 0 AS INT) FROM customer UNION ALL SELECT 'source_ref', c_custkey % 2 FROM customer) GROUP BY kind HAVING sum(n) > 0""")
def construct_totals(spark, sf_dir):
    _, got = _knobs(spark, sf_dir, columns=("constructs",))
    return construct_coverage(got.select(F.explode("constructs").alias("c")).select("c.*"))


@query("""WITH r AS (SELECT event_id, user_id, event_id * 10 AS lo, event_id * 10 + 8 AS hi FROM events), f AS (SELECT user_id, event_id * 10 + 5 AS lo, event_id * 10 + 12 AS hi, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS w FROM events WHERE event_type IN ('error', 'view'))
SELECT CASE w WHEN 2 THEN 'error' WHEN 1 THEN 'approx' ELSE 'resolved' END AS status, count(*) AS regions FROM (SELECT r.event_id, coalesce(max(w), 0) AS w FROM r LEFT JOIN f ON r.user_id = f.user_id AND f.lo < r.hi AND f.hi > r.lo GROUP BY r.event_id) GROUP BY 1""")
def interval_overlap(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    regions = ev.selectExpr("cast(user_id as string) as unit_id", "event_id as ord", "'stmt' as kind", "event_id * 10 as start", "event_id * 10 + 8 as end")
    found = ev.filter("event_type in ('error', 'view')").selectExpr("cast(user_id as string) as unit_id", "if(event_type = 'error', 'error', 'warning') as severity", "'region' as scope", "event_id * 10 + 5 as start", "event_id * 10 + 12 as end")
    return es.region_status(regions, found).groupBy("status").agg(F.count("*").alias("regions"))


# --- graphs ------------------------------------------------------------------------------------------------------


@query("""SELECT 's' || s_suppkey AS id, 0 AS rank FROM supplier UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier) THEN 1 ELSE 0 END FROM nation
UNION ALL SELECT 'r' || r_regionkey, CAST(greatest(coalesce((SELECT max(CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier) THEN 2 ELSE 1 END) FROM nation WHERE n_regionkey = r_regionkey), 0),
  CASE WHEN r_regionkey = 0 THEN coalesce((SELECT max(CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier) THEN 3 ELSE 2 END) FROM nation WHERE n_regionkey > 0), 1) ELSE 0 END) AS INT) FROM region""")
def layer_rank(spark, sf_dir):
    shared_folder(spark)
    nodes, edges = _relations(spark, sf_dir)
    return layout.ranks(nodes, edges)


@query("""SELECT o.id, min(p.id) OVER (PARTITION BY g) AS component FROM (SELECT 'c' || c_custkey AS id, c_nationkey AS g FROM customer UNION ALL SELECT 'n' || n_nationkey, n_nationkey FROM nation) o(id, g)
JOIN (SELECT 'c' || c_custkey AS id FROM customer UNION ALL SELECT 'n' || n_nationkey FROM nation) p ON o.id = p.id""")
def components(spark, sf_dir):
    shared_folder(spark)
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    nodes = c.selectExpr("concat('c', c_custkey) as id").union(n.selectExpr("concat('n', n_nationkey) as id"))
    return layout.components(nodes, c.selectExpr("concat('c', c_custkey) as src", "concat('n', c_nationkey) as dst"))


@query("""WITH w AS (SELECT s_suppkey AS ord, s_suppkey AS lo, s_nationkey AS hi FROM supplier) SELECT count(*) AS n FROM w a JOIN w b ON a.ord < b.ord AND (a.lo < b.lo) <> (a.hi < b.hi) AND a.hi <> b.hi""")
def crossings(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as ord", "0 as layer_lo", "1 as layer_hi", "s_suppkey as lo", "s_nationkey as hi", "concat('s', s_suppkey) as src", "concat('n', s_nationkey) as dst")
    return layout.crossings(rows)


@query("""WITH b AS (SELECT s_suppkey AS id, s_nationkey * 150.0 AS x, (s_suppkey % 10) * 55.0 AS y, 180.0 AS w, 60.0 AS h FROM supplier) SELECT count(*) AS n FROM b p JOIN b q ON p.id < q.id
AND p.x < q.x + q.w - 0.5 AND q.x < p.x + p.w - 0.5 AND p.y < q.y + q.h - 0.5 AND q.y < p.y + p.h - 0.5""")
def overlaps(spark, sf_dir):
    return layout.overlaps(table(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "s_nationkey * 150.0 as x", "(s_suppkey % 10) * 55.0 as y", "180.0 as w", "60.0 as h"))


@query("SELECT count(*) AS units, CAST(sum(3 + c_custkey % 3) AS BIGINT) AS nodes, CAST(sum(2 + c_custkey % 3) AS BIGINT) AS edges FROM customer")
def mermaid_lines(spark, sf_dir):
    """Lines of the rendered text, read back."""
    _, got = _customers(spark, sf_dir, _procedure("'EXEC p;', repeat(' UPDATE t SET a = 1;', int(c_custkey % 3))"), dialect="tsql", mode="flow")
    lines = F.col("lines")
    got = got.select(F.split(render.mermaid(F.col("nodes"), F.col("edges")), "\n").alias("lines"))
    kinds = got.select(F.size(F.filter(lines, lambda x: x.rlike(r"^  n[0-9]+(\(\[|\[|\{|>)"))).alias("nodes"), F.size(F.filter(lines, lambda x: x.rlike(r"^  n[0-9]+ -"))).alias("edges"))
    return kinds.agg(F.count("*").alias("units"), F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges"))


@query("""SELECT c_custkey, replace(replace(replace(replace(replace(replace(c_name || '<' || c_mktsegment || '>|"&"', '#', '#35;'), '&', '#amp;'), '"', '#quot;'), '<', '#lt;'), '>', '#gt;'), '|', '#124;') AS label,
  replace(replace(replace(replace(c_name || '<' || c_mktsegment || '>|"&"', '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;') AS xml FROM customer""")
def label_escape(spark, sf_dir):
    text = F.expr("concat(c_name, '<', c_mktsegment, '>|\"&\"')")
    return table(spark, sf_dir, "customer").select("c_custkey", render.escaped_label(text).alias("label"), render.xml_attribute(text).alias("xml"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 'corrupt_json' WHEN 2 THEN 'not_workspace' WHEN 3 THEN 'empty_workspace' ELSE 'none' END AS error, CASE WHEN o_orderkey % 5 IN (0, 4) AND o_orderkey % 2 = 0 THEN 'LR' ELSE 'TD' END AS dir,
  CAST(CASE WHEN o_orderkey % 5 IN (0, 4) THEN 1 ELSE 0 END AS INT) AS files, CASE WHEN o_orderkey % 5 = 4 THEN false ELSE true END AS migrated FROM orders""")
def workspace_migrate(spark, sf_dir):
    good = "concat('{\"version\":', if(o_orderkey % 5 = 4, '2', '1'), ',\"files\":[{\"name\":\"f', o_orderkey, '\",\"text\":\"x\"},{\"name\":1,\"text\":\"y\"},{\"name\":\"z\"}],\"options\":{\"dir\":\"', if(o_orderkey % 2 = 0, 'LR', 'XX'), '\",\"group\":false}}')"
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"case o_orderkey % 5 when 1 then '{{bad' when 2 then '[1]' when 3 then '{{\"files\":[]}}' else {good} end as json")
    return workspace.parse_workspaces(rows).select("o_orderkey", F.coalesce("error", F.lit("none")).alias("error"), "dir", F.size("files").alias("files"), "migrated")


@query("SELECT count(*) AS units, count(*) AS coverage_ok, count(*) AS ids_ok, count(*) AS spans_ok, count(*) AS edges_ok, count(*) AS tokens_ok FROM part")
def fuzz_invariants(spark, sf_dir):
    """Broken texts: characters cut, doubled and swapped by the row's numbers; what must hold for any text."""
    base = _KNOBS.replace("c_custkey", "p_partkey")
    cut = "int(p_partkey * 7919 % greatest(length(s), 1))"
    rows = table(spark, sf_dir, "part").selectExpr("*", f"{base} as s")
    rows = units(rows, f"case p_size % 5 when 0 then substring(s, 1, {cut}) when 1 then concat(substring(s, 1, {cut}), substring(s, {cut} + 4)) when 2 then concat(substring(s, 1, {cut}), substring(s, greatest({cut} - 20, 1))) when 3 then concat('(', replace(s, 'END', 'BEGIN')) else translate(s, ';=ae', '''([;') end", "p_partkey")
    got = rows.select("unit_id", F.length("sql").alias("size")).join(analysed(rows, mode="flow", columns=("coverage", "nodes", "edges", "attribution", "tokens_total")), "unit_id")
    a = F.col("attribution")
    ids = F.col("nodes.id")
    checks = {
        "coverage_ok": F.col("coverage").between(0, 1),
        "ids_ok": F.size(F.array_distinct(ids)) == F.size(ids),
        "spans_ok": F.forall("nodes", lambda n: n["start"].isNull() | ((n["start"] >= 0) & (n["end"] > n["start"]) & (n["end"] <= F.col("size")))),
        "edges_ok": F.forall("edges", lambda e: F.array_contains(ids, e["src"]) & F.array_contains(ids, e["dst"]) & e["kind"].isNotNull()),
        "tokens_ok": (a["resolved"] + a["opaque"] + a["semicolons"] + a["keywords"] + a["unresolved"] == a["total"]) & (a["total"] == F.col("tokens_total")),
    }
    return got.agg(F.count("*").alias("units"), *(F.count_if(c).alias(k) for k, c in checks.items()))


@query()
def layout_positions(spark, sf_dir):
    _, got = _knobs(spark, sf_dir, columns=("nodes", "edges"))
    return layout.layouts(got)


@query()
def drawio_files(spark, sf_dir):
    _, got = _knobs(spark, sf_dir, columns=("nodes", "edges"))
    return render.drawio(got)


@query()
def prompts(spark, sf_dir):
    rows, got = _knobs(spark, sf_dir, columns=("nodes", "edges", "dialect"))
    return rows.select("unit_id", "sql").join(got, "unit_id").select("unit_id", render.narration_prompt(render.mermaid(F.col("nodes"), F.col("edges")), F.col("sql"), F.col("dialect")).alias("prompt"))


@query("SELECT 1.0 AS attribution_rate, 0.0 AS tail_rate, 0.0 AS fallback_rate, 1.0 AS edge_kind_rate, 1.0 AS provenance_rate, 1.0 AS finding_span_rate FROM region WHERE r_regionkey = 0")
def corpus_rates(spark, sf_dir):
    _, got = _knobs(spark, sf_dir)
    return corpus_metrics(got).select("attribution_rate", "tail_rate", "fallback_rate", "edge_kind_rate", "provenance_rate", "finding_span_rate")


def entry(spark: SparkSession, sf_dir: str) -> Frame:
    """For each name, how many objects read it, write it and call it."""
    return estate_edges(spark, sf_dir)
