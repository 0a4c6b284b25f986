"""Lexer, parser and references: own samples for each construct, and both lexers against each other."""

import random
import re

import pytest
from sqlatlas.functions import lexer, references
from sqlatlas.functions.wording import clip, joined, summary
from sqlatlas.operators.parser import flatten, parse, walk

PIECES = ["SELECT ", "a", " ", "\n", "'it''s'", "E'a\\'b'", "N'x'", "[a]]b]", '"q""r"', "`t`", "--c\n", "/* x */", "/* a /* b */ */", "$$ b $$", "$t$ x $t$", "::int", "@v", "#t", "1.5", ".5", "1..3", "0xFF", "1e-3", "1_000", "<=", ":=", "->", "(", ")", ";", ",", "'", "[", "/*", "$$", "é", ":", "*/", "E'", "\t"]


def test_lexemes_cover_every_text():
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30)))
        assert "".join(m[0] for m in re.finditer(lexer.LEXEME, text)) == text
        toks, _ = lexer.lex(text)
        assert all(text[t.pos : t.end] == t.v for t in toks) and all(a.end <= b.pos for a, b in zip(toks, toks[1:], strict=False))


def test_both_lexers_agree(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", "/*" * 20 + "x" + "*/" * 20 + " a"]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "unit_id string, sql string")
    got = {}
    for r in lexer.tokens(rows).orderBy("unit_id", "ord").collect():
        got.setdefault(r.unit_id, []).append((r.kind, r.v, r.u, r.nl, r.pos, r.end))
    for i, t in enumerate(texts):
        assert got.get(str(i), []) == [tuple(x) for x in lexer.lex(t or "")[0]], t


def test_parenthesis_findings_agree(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("() a") for _ in range(12)) for _ in range(150)]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "unit_id string, sql string")
    got = {(r.unit_id, r.code, r.pos) for r in lexer.parenthesis_findings(lexer.tokens(rows)).collect()}
    assert got == {(str(i), f.code, f.start) for i, t in enumerate(texts) for f in lexer.lex(t)[1]}


@pytest.mark.parametrize(
    ("text", "kinds"),
    [("1..5", ["num", "op", "num"]), ("1.", ["num"]), (".5.3", ["num"]), ("::int", ["word"]), (":a", ["op", "word"]), ("a::b", ["word", "word"]), ("x'0F'", ["str"]), ("$1", ["op", "num"]), ("$$a$$", ["dollar"])],
)
def test_token_kinds(text, kinds):
    assert [t.kind for t in lexer.lex(text)[0]] == kinds


@pytest.mark.parametrize(
    ("text", "code"),
    [("'a", "unterminated_string"), ("E'a\\'", "unterminated_string"), ("[a", "unterminated_identifier"), ('"a', "unterminated_identifier"), ("`a", "unterminated_identifier"), ("/* /* */", "unterminated_comment"), ("$$ a", "unterminated_dollar_quote"), ("(", "unclosed_parenthesis"), (")", "unexpected_closing_parenthesis")],
)
def test_lexer_findings(text, code):
    assert [f.code for f in lexer.lex(text)[1]] == [code]


def kinds(sql, dialect):
    return [n.kind for n, _ in walk(parse(sql, dialect).tree)]


@pytest.mark.parametrize(
    ("dialect", "sql", "want"),
    [
        ("tsql", "SELECT 1 SELECT 2", ["stmt", "stmt"]),
        ("tsql", "INSERT INTO t SELECT 1", ["stmt"]),
        ("tsql", "SELECT CASE WHEN a = 1 THEN 2 END FROM t", ["stmt"]),
        ("tsql", "IF @a = 1 SELECT 1 ELSE SELECT 2", ["if", "stmt", "stmt"]),
        ("tsql", "WHILE 1 = 1 BEGIN BREAK; CONTINUE; END", ["while", "block", "break", "continue"]),
        ("tsql", "BEGIN TRY SELECT 1 END TRY BEGIN CATCH THROW END CATCH", ["try", "stmt", "throw"]),
        ("tsql", "RAISERROR('x', 16, 1)", ["throw"]),
        ("tsql", "RAISERROR('x', 10, 1)", ["stmt"]),
        ("tsql", "a: GOTO a", ["label", "goto"]),
        ("tsql", "EXEC @rc = p", ["stmt"]),
        ("tsql", "EXEC @sql", ["dynamic"]),
        ("tsql", "SELECT 1\nGO\nSELECT 2", ["stmt", "go", "stmt"]),
        ("tsql", "MERGE t USING s ON 1 = 1 WHEN MATCHED THEN UPDATE SET a = 1;", ["stmt"]),
        ("db2", "IF a THEN SET b = 1; ELSEIF c THEN SET d = 1; ELSE SET e = 1; END IF;", ["if", "block", "stmt", "if", "block", "stmt", "block", "stmt"]),
        ("db2", "l: REPEAT SET a = 1; UNTIL a > 3 END REPEAT l;", ["repeat", "block", "stmt"]),
        ("db2", "DECLARE EXIT HANDLER FOR SQLEXCEPTION SET a = 1;", ["handler", "stmt"]),
        ("db2", "FOR r AS c CURSOR FOR SELECT 1 FROM t DO SET a = 1; END FOR;", ["for", "block", "stmt"]),
        ("db2", "CASE a WHEN 1 THEN SET b = 1; ELSE SET c = 1; END CASE;", ["case", "stmt", "stmt"]),
        ("db2", "EXECUTE IMMEDIATE s", ["dynamic"]),
        ("db2", "SIGNAL SQLSTATE '75000'", ["throw"]),
        ("plpgsql", "<<l>> LOOP EXIT l WHEN a; END LOOP l;", ["loop", "block", "break"]),
        ("plpgsql", "BEGIN RAISE NOTICE 'a'; EXCEPTION WHEN OTHERS THEN RAISE; END;", ["try", "stmt", "throw"]),
        ("plpgsql", "RETURN QUERY SELECT 1; RETURN 1;", ["stmt", "return"]),
        ("plpgsql", "EXECUTE 'a' || b", ["dynamic"]),
        ("sqlite", "SELECT RAISE(ABORT, 'x')", ["sqlite_raise"]),
        ("sqlite", "SELECT RAISE(IGNORE) WHERE a = 1", ["if", "sqlite_raise"]),
        ("sqlite", "SELECT CASE WHEN a THEN RAISE(FAIL, 'x') ELSE RAISE(ROLLBACK, 'y') END", ["case", "sqlite_raise", "sqlite_raise"]),
    ],
)
def test_statements(dialect, sql, want):
    assert kinds(sql, dialect) == want


def test_headers():
    p = parse("CREATE PROCEDURE dbo.p @a INT, @b INT AS SELECT 1", "tsql")
    assert (p.header.name, p.header.params, p.header.kind) == ("dbo.p", "@a, @b", "PROCEDURE")
    p = parse("CREATE TRIGGER t BEFORE UPDATE ON a WHEN NEW.x < 0 BEGIN SELECT 1; END", "sqlite")
    assert joined(p.header.gate) == "NEW.x < 0"
    p = parse("CREATE FUNCTION f(a int, OUT b text) RETURNS int AS $$ BEGIN RETURN 1; END $$", "plpgsql")
    assert p.header.params == "a, b" and p.toks[0].pos == p.header.offset + 1
    assert parse("CREATE VIEW v WITH SCHEMABINDING AS SELECT 1", "tsql").toks[0].u == "SELECT"


def test_tree_rows_nest():
    rows = flatten(parse("IF @a = 1 BEGIN SELECT 1 WHILE 1 = 1 SELECT 2 END", "tsql").tree)
    by = {r["node_id"]: r for r in rows}
    for r in rows:
        if r["parent_id"] is not None:
            up = by[r["parent_id"]]
            assert up["pre"] < r["pre"] < r["post"] < up["post"] and r["depth"] == up["depth"] + 1


@pytest.mark.parametrize(
    ("sql", "names"),
    [
        ("SELECT 1 FROM a, b JOIN c ON 1 = 1, d", ["a", "b", "c"]),
        ("SELECT 1 FROM (SELECT 1 FROM a) x, b", ["a"]),
        ("SELECT EXTRACT(YEAR FROM d) FROM t", ["d", "t"]),
        ("SELECT 1 FROM LATERAL (SELECT 1 FROM a) x", ["a"]),
        ("DELETE FROM t USING u", ["t", "u"]),
        ("SELECT 1 FROM a.b.c CROSS APPLY f(1)", ["a.b.c", "f"]),
    ],
)
def test_sources(sql, names):
    assert references.sources(lexer.lex(sql)[0]).names == names


@pytest.mark.parametrize(
    ("sql", "reads", "writes", "calls", "rows"),
    [
        ("INSERT OR REPLACE INTO t SELECT 1 FROM a", ["a"], ["t"], [], False),
        ("WITH c AS (SELECT 1 FROM a) UPDATE t SET x = 1 FROM c", ["a"], ["t"], [], False),
        ("INSERT INTO t WITH c AS (SELECT 1 FROM a) SELECT 1 FROM c", ["a", "c"], ["t"], [], False),
        ("UPDATE TOP (5) t SET x = 1", [], ["t"], [], False),
        ("SELECT a INTO #x FROM b", ["b"], ["#x"], [], False),
        ("SELECT a INTO @x FROM b", ["b"], [], [], False),
        ("TRUNCATE TABLE t", [], ["t"], [], False),
        ("EXEC @rc = dbo.p 1", [], [], ["dbo.p"], False),
        ("SELECT 1", [], [], [], True),
    ],
)
def test_facts(sql, reads, writes, calls, rows):
    f = references.facts(lexer.lex(sql)[0])
    assert (f.reads, f.writes, f.calls, f.result_set) == (reads, writes, calls, rows)


def test_wording():
    t = lambda s: lexer.lex(s)[0]
    assert joined(t("SELECT f( a , b ) , -1 , a - 1")) == "SELECT f(a, b), -1, a - 1"
    assert summary(t("SELECT a , b FROM dbo . t WHERE x = 1"), 52) == "SELECT … FROM dbo.t"
    assert summary(t("DECLARE c CURSOR FOR SELECT 1"), 52) == "DECLARE CURSOR c"
    assert clip("a" * 10, 5) == "aaaa…"
