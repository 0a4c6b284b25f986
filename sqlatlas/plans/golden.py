"""Small programs with the graphs and findings they must give, one family a query.

Programs and expectations hold the number ``{k}`` of a supplier row, so the checking SQL builds every expected node, edge and finding from
that table alone. ``{next}`` is the number after it.
"""

# ruff: noqa: E501
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..operators.flow import Options
from .engine import analysed
from .queries import query, table

#: Four digits for every row, so that places in the text do not depend on the row.
NUMBER = "(1000 + s_suppkey % 8999)"


@dataclass(frozen=True)
class Case:
    dialect: str
    view: str
    options: dict = field(hash=False)
    sql: str
    mode: tuple[str, ...] = ()
    node: tuple[str, ...] = ()
    edge: tuple[str, ...] = ()
    finding: tuple[str, ...] = ()

    def rows(self) -> list[tuple[str, str]]:
        return [(part, x) for part in ("mode", "node", "edge", "finding") for x in getattr(self, part)]

    def parts(self) -> list[str]:
        return [part for part in ("mode", "node", "edge", "finding") if getattr(self, part)]


FAMILIES: dict[str, tuple[Case, ...]] = {
    "pg_handlers": (
        Case(
            "plpgsql", "flow", {"group": False, "fan_in": True},
            'CREATE FUNCTION f{k}() RETURNS int AS $$ BEGIN RAISE division_by_zero; CALL p{k}(); EXCEPTION WHEN unique_violation THEN a := 1; WHEN division_by_zero THEN RETURN {k}; WHEN OTHERS THEN a := 3; END $$',
            node=(
                'start: f{k}',
                'try: BEGIN exception block · subtransaction',
                'err: RAISE division_by_zero',
                'call: CALL p{k}',
                'catch: EXCEPTION WHEN unique_violation',
                'catch: EXCEPTION WHEN division_by_zero',
                'catch: EXCEPTION WHEN OTHERS',
                'tran: Implicit rollback · unique_violation\nPersistent changes undone · variables preserved',
                'stmt: a := 1',
                'tran: Implicit rollback · division_by_zero\nPersistent changes undone · variables preserved',
                'ret: RETURN {k}',
                'tran: Implicit rollback · OTHERS\nPersistent changes undone · variables preserved',
                'stmt: a := 3',
                'start: End',
            ),
            edge=(
                'BEGIN exception block · subtransaction -> RAISE division_by_zero (control)',
                'RAISE division_by_zero -> EXCEPTION WHEN division_by_zero (exception)',
                'EXCEPTION WHEN division_by_zero -> Implicit rollback · division_by_zero\nPersistent changes undone · variables preserved (control)',
                'Implicit rollback · division_by_zero\nPersistent changes undone · variables preserved -> RETURN {k} (control)',
                'f{k} -> BEGIN exception block · subtransaction (control)',
                'RETURN {k} -> End (exception)',
            ),
        ),
        Case(
            "plpgsql", "flow", {"group": False},
            'CREATE FUNCTION f{k}() RETURNS int AS $$ BEGIN UPDATE t{k} SET a = 1; EXCEPTION WHEN OTHERS THEN RAISE; END $$',
            node=(
                'start: f{k}',
                'try: BEGIN exception block · subtransaction',
                'io: UPDATE t{k}',
                'catch: EXCEPTION WHEN OTHERS',
                'tran: Implicit rollback · OTHERS\nPersistent changes undone · variables preserved',
                'err: RAISE',
                'start: End',
            ),
            edge=(
                'BEGIN exception block · subtransaction -> UPDATE t{k} (control)',
                'BEGIN exception block · subtransaction -error> EXCEPTION WHEN OTHERS (exception)',
                'EXCEPTION WHEN OTHERS -> Implicit rollback · OTHERS\nPersistent changes undone · variables preserved (control)',
                'Implicit rollback · OTHERS\nPersistent changes undone · variables preserved -> RAISE (control)',
                'f{k} -> BEGIN exception block · subtransaction (control)',
                'UPDATE t{k} -> End (control)',
            ),
        ),
        Case(
            "plpgsql", "flow", {"group": False},
            "CREATE FUNCTION f{k}() RETURNS int AS $$ BEGIN BEGIN RAISE SQLSTATE '22012'; EXCEPTION WHEN SQLSTATE '22000' THEN b := {k}; END; EXCEPTION WHEN assert_failure THEN c := 1; END $$",
            node=(
                'start: f{k}',
                'try: BEGIN exception block · subtransaction',
                'try: BEGIN exception block · subtransaction',
                "err: RAISE SQLSTATE '22012'",
                "catch: EXCEPTION WHEN SQLSTATE '22000'",
                "tran: Implicit rollback · SQLSTATE '22000'\nPersistent changes undone · variables preserved",
                'stmt: b := {k}',
                'catch: EXCEPTION WHEN assert_failure',
                'tran: Implicit rollback · assert_failure\nPersistent changes undone · variables preserved',
                'stmt: c := 1',
                'start: End',
            ),
            edge=(
                "BEGIN exception block · subtransaction -> RAISE SQLSTATE '22012' (control)",
                "RAISE SQLSTATE '22012' -> EXCEPTION WHEN SQLSTATE '22000' (exception)",
                "BEGIN exception block · subtransaction -error> EXCEPTION WHEN SQLSTATE '22000' (exception)",
                "EXCEPTION WHEN SQLSTATE '22000' -> Implicit rollback · SQLSTATE '22000'\nPersistent changes undone · variables preserved (control)",
                "Implicit rollback · SQLSTATE '22000'\nPersistent changes undone · variables preserved -> b := {k} (control)",
                'BEGIN exception block · subtransaction -> BEGIN exception block · subtransaction (control)',
                'BEGIN exception block · subtransaction -error> EXCEPTION WHEN assert_failure (exception)',
                'EXCEPTION WHEN assert_failure -> Implicit rollback · assert_failure\nPersistent changes undone · variables preserved (control)',
                'Implicit rollback · assert_failure\nPersistent changes undone · variables preserved -> c := 1 (control)',
                'f{k} -> BEGIN exception block · subtransaction (control)',
                'b := {k} -> End (control)',
                'c := 1 -> End (control)',
            ),
        ),
    ),
    "db2_handlers": (
        Case(
            "db2", "flow", {"group": False, "fan_in": True},
            'CREATE PROCEDURE p{k}() BEGIN DECLARE CONTINUE HANDLER FOR NOT FOUND SET d = {k}; FETCH c INTO v; UPDATE t SET a = 1; END',
            node=(
                'start: p{k}',
                'catch: CONTINUE HANDLER FOR NOT FOUND',
                'stmt: SET d = {k}',
                'flowctl: Resume after raising statement',
                'cursor: FETCH c INTO v',
                'io: UPDATE t',
                'start: End',
            ),
            edge=(
                'CONTINUE HANDLER FOR NOT FOUND -> SET d = {k} (control)',
                'SET d = {k} -> Resume after raising statement (control)',
                'FETCH c INTO v -NOT FOUND> CONTINUE HANDLER FOR NOT FOUND (exception)',
                'FETCH c INTO v -> UPDATE t (control)',
                'p{k} -> FETCH c INTO v (control)',
                'UPDATE t -> End (control)',
                'Resume after raising statement -resume> UPDATE t (exception)',
            ),
        ),
        Case(
            "db2", "flow", {"group": False},
            'CREATE PROCEDURE p{k}() BEGIN DECLARE EXIT HANDLER FOR SQLEXCEPTION SET e = {k}; UPDATE t{k} SET a = 1; DELETE FROM u; END',
            node=(
                'start: p{k}',
                'catch: EXIT HANDLER FOR SQLEXCEPTION',
                'stmt: SET e = {k}',
                'catch: Exit compound block',
                'io: UPDATE t{k}',
                'io: DELETE FROM u',
                'start: End',
            ),
            edge=(
                'EXIT HANDLER FOR SQLEXCEPTION -> SET e = {k} (control)',
                'SET e = {k} -> Exit compound block (control)',
                'UPDATE t{k} -SQLEXCEPTION> EXIT HANDLER FOR SQLEXCEPTION (exception)',
                'UPDATE t{k} -> DELETE FROM u (control)',
                'p{k} -> UPDATE t{k} (control)',
                'DELETE FROM u -> End (control)',
                'Exit compound block -handler exit> End (control)',
            ),
        ),
        Case(
            "db2", "flow", {"group": False},
            'CREATE PROCEDURE p{k}() BEGIN ATOMIC DECLARE UNDO HANDLER FOR SQLEXCEPTION SET e = 1; INSERT INTO t{k} VALUES (1); END',
            node=(
                'start: p{k}',
                'try: BEGIN ATOMIC · rollback scope',
                'catch: UNDO HANDLER FOR SQLEXCEPTION',
                'stmt: SET e = 1',
                'catch: Undo and exit compound block',
                'io: INSERT INTO t{k}',
                'err: Implicit rollback · ATOMIC block',
                'start: End',
            ),
            edge=(
                'UNDO HANDLER FOR SQLEXCEPTION -> SET e = 1 (control)',
                'SET e = 1 -> Undo and exit compound block (control)',
                'INSERT INTO t{k} -SQLEXCEPTION> UNDO HANDLER FOR SQLEXCEPTION (exception)',
                'BEGIN ATOMIC · rollback scope -> INSERT INTO t{k} (control)',
                'Undo and exit compound block -undo> Implicit rollback · ATOMIC block (control)',
                'p{k} -> BEGIN ATOMIC · rollback scope (control)',
                'INSERT INTO t{k} -> End (control)',
            ),
        ),
    ),
    "case_and_loops": (
        Case(
            "plpgsql", "flow", {"group": False},
            'CREATE FUNCTION f() RETURNS int AS $$ BEGIN CASE x WHEN {k} THEN a := 1; WHEN 2 THEN b := 2; ELSE c := 3; END CASE; d := 4; END $$',
            node=(
                'start: f',
                'cond: x = {k}',
                'stmt: a := 1',
                'cond: x = 2',
                'stmt: b := 2',
                'stmt: c := 3',
                'stmt: d := 4',
                'start: End',
            ),
            edge=(
                'x = {k} -yes> a := 1 (control)',
                'x = {k} -no> x = 2 (control)',
                'x = 2 -yes> b := 2 (control)',
                'x = 2 -else> c := 3 (control)',
                'a := 1 -> d := 4 (control)',
                'b := 2 -> d := 4 (control)',
                'c := 3 -> d := 4 (control)',
                'f -> x = {k} (control)',
                'd := 4 -> End (control)',
            ),
        ),
        Case(
            "db2", "flow", {"group": False},
            'CREATE PROCEDURE p() BEGIN REPEAT SET a = {k}; UNTIL a > 1 END REPEAT; SET b = 2; END',
            node=(
                'start: p',
                'loop: until a > 1',
                'stmt: SET a = {k}',
                'stmt: SET b = 2',
                'start: End',
            ),
            edge=(
                'SET a = {k} -> until a > 1 (control)',
                'until a > 1 -no> SET a = {k} (control)',
                'until a > 1 -yes> SET b = 2 (control)',
                'p -> SET a = {k} (control)',
                'SET b = 2 -> End (control)',
            ),
        ),
        Case(
            "plpgsql", "flow", {"group": False},
            'CREATE FUNCTION f() RETURNS int AS $$ BEGIN FOR r IN 1..{k} LOOP a := r; END LOOP; FOREACH y IN ARRAY z LOOP b := y; END LOOP; END $$',
            node=(
                'start: f',
                'loop: for r IN 1..{k}',
                'stmt: a := r',
                'loop: for y IN ARRAY z',
                'stmt: b := y',
                'start: End',
            ),
            edge=(
                'for r IN 1..{k} -yes> a := r (control)',
                'a := r -> for r IN 1..{k} (control)',
                'for y IN ARRAY z -yes> b := y (control)',
                'b := y -> for y IN ARRAY z (control)',
                'for r IN 1..{k} -done> for y IN ARRAY z (control)',
                'f -> for r IN 1..{k} (control)',
                'for y IN ARRAY z -done> End (control)',
            ),
        ),
        Case(
            "plpgsql", "flow", {"group": False},
            'CREATE FUNCTION f() RETURNS int AS $$ BEGIN <<l{k}>> LOOP EXIT l{k} WHEN a > 1; CONTINUE; END LOOP; END $$',
            node=(
                'start: f',
                'loop: loop',
                'cond: EXIT l{k} WHEN a > 1',
                'flowctl: CONTINUE',
                'start: End',
            ),
            edge=(
                'CONTINUE -continue> loop (control)',
                'EXIT l{k} WHEN a > 1 -no> CONTINUE (control)',
                'loop -> EXIT l{k} WHEN a > 1 (control)',
                'f -> loop (control)',
                'EXIT l{k} WHEN a > 1 -yes> End (control)',
            ),
        ),
        Case(
            "db2", "flow", {"group": False},
            'CREATE PROCEDURE p() BEGIN WHILE a < {k} DO SET a = a + 1; END WHILE; FOR r AS SELECT x FROM t{k} DO SET b = x; END FOR; END',
            node=(
                'start: p',
                'loop: a < {k}',
                'stmt: SET a = a + 1',
                'loop: for r AS SELECT x FROM t{k}',
                'stmt: SET b = x',
                'start: End',
            ),
            edge=(
                'a < {k} -yes> SET a = a + 1 (control)',
                'SET a = a + 1 -> a < {k} (control)',
                'for r AS SELECT x FROM t{k} -yes> SET b = x (control)',
                'SET b = x -> for r AS SELECT x FROM t{k} (control)',
                'a < {k} -done> for r AS SELECT x FROM t{k} (control)',
                'p -> a < {k} (control)',
                'for r AS SELECT x FROM t{k} -done> End (control)',
            ),
        ),
    ),
    "transaction_notes": (
        Case(
            "tsql", "flow", {"group": False},
            'CREATE PROCEDURE p{k} AS SET XACT_ABORT ON; BEGIN TRAN; BEGIN TRY UPDATE t{k} SET a = 1; COMMIT; END TRY BEGIN CATCH ROLLBACK; THROW; END CATCH',
            node=(
                'start: p{k}',
                'stmt: SET XACT_ABORT ON — runtime errors abort transactions',
                'tran: BEGIN TRAN — increment transaction depth',
                'try: BEGIN TRY',
                'io: UPDATE t{k}',
                'tran: COMMIT — decrement depth; durable only at outermost',
                'catch: BEGIN CATCH · XACT_ABORT ON at TRY entry; inspect XACT_STATE',
                'tran: ROLLBACK — roll back active transaction; reset depth to 0',
                'err: THROW',
                'start: End',
            ),
            edge=(
                'SET XACT_ABORT ON — runtime errors abort transactions -> BEGIN TRAN — increment transaction depth (control)',
                'UPDATE t{k} -> COMMIT — decrement depth; durable only at outermost (control)',
                'BEGIN TRY -> UPDATE t{k} (control)',
                'BEGIN TRY -error> BEGIN CATCH · XACT_ABORT ON at TRY entry; inspect XACT_STATE (exception)',
                'ROLLBACK — roll back active transaction; reset depth to 0 -> THROW (control)',
                'BEGIN CATCH · XACT_ABORT ON at TRY entry; inspect XACT_STATE -> ROLLBACK — roll back active transaction; reset depth to 0 (control)',
                'BEGIN TRAN — increment transaction depth -> BEGIN TRY (control)',
                'p{k} -> SET XACT_ABORT ON — runtime errors abort transactions (control)',
                'COMMIT — decrement depth; durable only at outermost -> End (control)',
            ),
        ),
        Case(
            "tsql", "flow", {"group": False},
            'CREATE PROCEDURE p{k} AS BEGIN TRAN; SAVE TRAN s{k}; BEGIN TRAN; COMMIT; ROLLBACK TRAN s{k}; ROLLBACK; COMMIT',
            node=(
                'start: p{k}',
                'tran: BEGIN TRAN — increment transaction depth',
                'tran: SAVE TRAN s{k} — create savepoint s{k} if committable; depth unchanged',
                'tran: BEGIN TRAN — begin nested transaction; increment depth',
                'tran: COMMIT — nested commit only; decrement depth',
                'tran: ROLLBACK TRAN s{k} — roll back to savepoint s{k}; depth unchanged',
                'tran: ROLLBACK — roll back active transaction; reset depth to 0',
                'err: COMMIT — invalid: no active transaction',
                'start: End',
            ),
            edge=(
                'BEGIN TRAN — increment transaction depth -> SAVE TRAN s{k} — create savepoint s{k} if committable; depth unchanged (control)',
                'SAVE TRAN s{k} — create savepoint s{k} if committable; depth unchanged -> BEGIN TRAN — begin nested transaction; increment depth (control)',
                'BEGIN TRAN — begin nested transaction; increment depth -> COMMIT — nested commit only; decrement depth (control)',
                'COMMIT — nested commit only; decrement depth -> ROLLBACK TRAN s{k} — roll back to savepoint s{k}; depth unchanged (control)',
                'ROLLBACK TRAN s{k} — roll back to savepoint s{k}; depth unchanged -> ROLLBACK — roll back active transaction; reset depth to 0 (control)',
                'ROLLBACK — roll back active transaction; reset depth to 0 -> COMMIT — invalid: no active transaction (control)',
                'p{k} -> BEGIN TRAN — increment transaction depth (control)',
            ),
        ),
        Case(
            "tsql", "flow", {"group": False},
            'CREATE PROCEDURE p{k} AS SET XACT_ABORT OFF; IF @@TRANCOUNT > {k} ROLLBACK TRAN; IF XACT_STATE() = 1 COMMIT',
            node=(
                'start: p{k}',
                'stmt: SET XACT_ABORT OFF — statement errors may leave transaction active',
                'cond: @@TRANCOUNT > {k} · transaction depth?',
                'tran: ROLLBACK TRAN — roll back active transaction; reset depth to 0',
                'cond: XACT_STATE() = 1 · committable?',
                'tran: COMMIT — commit committable transaction; decrement depth',
                'start: End',
            ),
            edge=(
                '@@TRANCOUNT > {k} · transaction depth? -yes · depth ≥{next} · nested transaction> ROLLBACK TRAN — roll back active transaction; reset depth to 0 (control)',
                'SET XACT_ABORT OFF — statement errors may leave transaction active -> @@TRANCOUNT > {k} · transaction depth? (control)',
                'XACT_STATE() = 1 · committable? -yes · 1 · committable> COMMIT — commit committable transaction; decrement depth (control)',
                'ROLLBACK TRAN — roll back active transaction; reset depth to 0 -> XACT_STATE() = 1 · committable? (control)',
                '@@TRANCOUNT > {k} · transaction depth? -no · depth 0–{k}> XACT_STATE() = 1 · committable? (control)',
                'p{k} -> SET XACT_ABORT OFF — statement errors may leave transaction active (control)',
                'COMMIT — commit committable transaction; decrement depth -> End (control)',
                'XACT_STATE() = 1 · committable? -no · not committable> End (control)',
            ),
        ),
    ),
    "statement_lists": (
        Case(
            "tsql", "flow", {},
            'CREATE PROCEDURE p AS PRINT 1; PRINT 2; PRINT 3; PRINT 4; PRINT 5; PRINT 6; PRINT {k}; UPDATE t SET a = 1; PRINT 9',
            node=(
                'start: p',
                'stmt: PRINT 1\nPRINT 2\nPRINT 3\nPRINT 4\nPRINT 5\nPRINT 6',
                'stmt: PRINT {k}',
                'io: UPDATE t',
                'stmt: PRINT 9',
                'start: End',
            ),
            edge=(
                'PRINT 1\nPRINT 2\nPRINT 3\nPRINT 4\nPRINT 5\nPRINT 6 -> PRINT {k} (control)',
                'PRINT {k} -> UPDATE t (control)',
                'UPDATE t -> PRINT 9 (control)',
                'p -> PRINT 1\nPRINT 2\nPRINT 3\nPRINT 4\nPRINT 5\nPRINT 6 (control)',
                'PRINT 9 -> End (control)',
            ),
        ),
        Case(
            "tsql", "flow", {"group": False},
            'CREATE PROCEDURE p AS RETURN {k}; PRINT 2; UPDATE t SET a = 1',
            node=(
                'start: p',
                'ret: RETURN {k}',
                'stmt: PRINT 2',
                'io: UPDATE t',
                'start: End',
            ),
            edge=(
                'p -> RETURN {k} (control)',
                'RETURN {k} -> End (exception)',
            ),
        ),
        Case(
            "tsql", "flow", {"group": False, "number": True},
            'CREATE PROCEDURE p AS EXEC q{k}; IF @a = 1 PRINT 2; UPDATE t SET a = 1',
            node=(
                'start: p',
                'call: 1. EXEC q{k}',
                'cond: @a = 1',
                'stmt: 2. PRINT 2',
                'io: 3. UPDATE t',
                'start: End',
            ),
            edge=(
                '@a = 1 -yes> 2. PRINT 2 (control)',
                '1. EXEC q{k} -> @a = 1 (call)',
                '2. PRINT 2 -> 3. UPDATE t (control)',
                '@a = 1 -no> 3. UPDATE t (control)',
                'p -> 1. EXEC q{k} (control)',
                '3. UPDATE t -> End (control)',
            ),
        ),
        Case(
            "tsql", "flow", {"group": False},
            'PRINT {k}\nGO\nPRINT 2\nGO\nEXEC q',
            node=(
                'start: Script start',
                'stmt: PRINT {k}',
                'stmt: PRINT 2',
                'call: EXEC q',
                'start: End',
            ),
            edge=(
                'PRINT {k} -> PRINT 2 (control)',
                'PRINT 2 -> EXEC q (control)',
                'Script start -> PRINT {k} (control)',
                'EXEC q -> End (call)',
            ),
        ),
        Case(
            "tsql", "flow", {"group": False},
            'CREATE PROCEDURE p AS UPDATE dbo.a_rather_long_table_name_{k} SET first_column = 1, second_column = 2, third_column = 3 WHERE fourth_column = 4',
            node=(
                'start: p',
                'io: UPDATE dbo.a_rather_long_table_name_{k}',
                'start: End',
            ),
            edge=(
                'p -> UPDATE dbo.a_rather_long_table_name_{k} (control)',
                'UPDATE dbo.a_rather_long_table_name_{k} -> End (control)',
            ),
        ),
        Case(
            "tsql", "flow", {"group": False, "detail": "full"},
            "CREATE PROCEDURE p AS UPDATE dbo.t{k} SET a = 1, b = 'it''s' WHERE c = 4 AND d IN (1, 2, 3)",
            node=(
                'start: p',
                "io: UPDATE dbo.t{k} SET a = 1, b = 'it''s' WHERE c = 4 AND d IN (1, 2, 3)",
                'start: End',
            ),
            edge=(
                "p -> UPDATE dbo.t{k} SET a = 1, b = 'it''s' WHERE c = 4 AND d IN (1, 2, 3) (control)",
                "UPDATE dbo.t{k} SET a = 1, b = 'it''s' WHERE c = 4 AND d IN (1, 2, 3) -> End (control)",
            ),
        ),
    ),
    "jumps": (
        Case(
            "tsql", "flow", {"group": False},
            'CREATE PROCEDURE p AS again: PRINT {k}; IF @a = 1 GOTO again; GOTO done{k}; done{k}: RETURN',
            node=(
                'start: p',
                'flowctl: again:',
                'stmt: PRINT {k}',
                'cond: @a = 1',
                'flowctl: GOTO again',
                'flowctl: GOTO done{k}',
                'flowctl: done{k}:',
                'ret: RETURN',
                'start: End',
            ),
            edge=(
                'again: -> PRINT {k} (control)',
                '@a = 1 -yes> GOTO again (control)',
                'PRINT {k} -> @a = 1 (control)',
                '@a = 1 -no> GOTO done{k} (control)',
                'done{k}: -> RETURN (control)',
                'p -> again: (control)',
                'RETURN -> End (exception)',
                'GOTO again -goto> again: (exception)',
                'GOTO done{k} -goto> done{k}: (exception)',
            ),
        ),
        Case(
            "tsql", "flow", {"group": False},
            'CREATE PROCEDURE p AS WHILE @a < {k} BEGIN IF @a = 1 CONTINUE; IF @a = 2 BREAK; SET @a = 3 END',
            node=(
                'start: p',
                'loop: @a < {k}',
                'cond: @a = 1',
                'flowctl: CONTINUE',
                'cond: @a = 2',
                'flowctl: BREAK',
                'stmt: SET @a = 3',
                'start: End',
            ),
            edge=(
                'CONTINUE -continue> @a < {k} (control)',
                '@a = 1 -yes> CONTINUE (control)',
                '@a = 2 -yes> BREAK (control)',
                '@a = 1 -no> @a = 2 (control)',
                '@a = 2 -no> SET @a = 3 (control)',
                '@a < {k} -yes> @a = 1 (control)',
                'SET @a = 3 -> @a < {k} (control)',
                'p -> @a < {k} (control)',
                'BREAK -> End (control)',
                '@a < {k} -done> End (control)',
            ),
        ),
        Case(
            "db2", "flow", {"group": False},
            'CREATE PROCEDURE p() BEGIN o{k}: WHILE a < 1 DO i: LOOP LEAVE o{k}; END LOOP i; ITERATE z; END WHILE; END',
            node=(
                'start: p',
                'loop: a < 1',
                'loop: loop',
                'flowctl: LEAVE o{k}',
                'flowctl: ITERATE z',
                'flowctl: Unresolved label: z',
                'start: End',
            ),
            edge=(
                'loop -> LEAVE o{k} (control)',
                'ITERATE z -goto> Unresolved label: z (exception)',
                'a < 1 -yes> loop (control)',
                'p -> a < 1 (control)',
                'LEAVE o{k} -> End (control)',
                'a < 1 -done> End (control)',
            ),
            finding=(
                'warning goto_unresolved region 82-91',
            ),
        ),
    ),
    "sqlite_raise": (
        Case(
            "sqlite", "flow", {"group": False},
            "CREATE TRIGGER t{k} BEFORE UPDATE ON a WHEN NEW.x < {k} BEGIN SELECT RAISE(ABORT, 'no'); UPDATE b SET c = 1; END",
            node=(
                'start: t{k}',
                'cond: NEW.x < {k}',
                'err: RAISE ABORT — roll back statement changes',
                'io: UPDATE b',
                'start: End',
            ),
            edge=(
                't{k} -> NEW.x < {k} (control)',
                'NEW.x < {k} -yes> RAISE ABORT — roll back statement changes (control)',
                'NEW.x < {k} -no> End (control)',
            ),
        ),
        Case(
            "sqlite", "flow", {"group": False},
            'CREATE TRIGGER t{k} AFTER INSERT ON a BEGIN SELECT RAISE(IGNORE) WHERE NEW.x = {k}; DELETE FROM b; END',
            node=(
                'start: t{k}',
                'cond: NEW.x = {k}',
                'halt: RAISE IGNORE — abandon trigger/query; no rollback',
                'io: DELETE FROM b',
                'start: End',
            ),
            edge=(
                'NEW.x = {k} -yes> RAISE IGNORE — abandon trigger/query; no rollback (control)',
                'NEW.x = {k} -no> DELETE FROM b (control)',
                't{k} -> NEW.x = {k} (control)',
                'DELETE FROM b -> End (control)',
            ),
        ),
        Case(
            "sqlite", "flow", {"group": False},
            "CREATE TRIGGER t{k} AFTER INSERT ON a BEGIN SELECT CASE WHEN NEW.x = {k} THEN RAISE(ROLLBACK, 'r') WHEN NEW.y = 2 THEN RAISE(FAIL, 'f') END; END",
            node=(
                'start: t{k}',
                'cond: NEW.x = {k}',
                'err: RAISE ROLLBACK — roll back transaction',
                'cond: NEW.y = 2',
                'err: RAISE FAIL — stop statement; keep prior changes',
                'start: End',
            ),
            edge=(
                'NEW.x = {k} -yes> RAISE ROLLBACK — roll back transaction (control)',
                'NEW.x = {k} -no> NEW.y = 2 (control)',
                'NEW.y = 2 -yes> RAISE FAIL — stop statement; keep prior changes (control)',
                't{k} -> NEW.x = {k} (control)',
                'NEW.y = 2 -no> End (control)',
            ),
        ),
    ),
    "object_queries": (
        Case(
            "tsql", "query", {},
            'CREATE PROCEDURE p AS SELECT a FROM t{k}; INSERT INTO u SELECT b FROM v{k} JOIN w ON 1 = 1; PRINT 1',
            node=(
                'final: SELECT … FROM t{k}',
                'src: t{k}',
                'final: INSERT INTO u\n1 join',
                'src: v{k}',
                'src: w',
            ),
            edge=(
                't{k} -> SELECT … FROM t{k} (dependency)',
                'v{k} -> INSERT INTO u\n1 join (dependency)',
                'w -> INSERT INTO u\n1 join (dependency)',
            ),
        ),
        Case(
            "tsql", "query", {"sources": False},
            'WITH c AS (SELECT 1 FROM t{k}) SELECT 1 FROM c JOIN d{k} ON 1 = 1',
            node=(
                'cte: c',
                'final: SELECT … FROM c\n1 join',
            ),
            edge=(
                'c -> SELECT … FROM c\n1 join (dependency)',
            ),
        ),
        Case(
            "tsql", "query", {},
            'CREATE PROCEDURE p{k} AS PRINT 1',
            node=(
                'final: No query-bearing statements found',
            ),
        ),
        Case(
            "tsql", "auto", {},
            'SELECT a, count(*) FROM t{k} WHERE b = 1 GROUP BY a',
            mode=(
                'query',
            ),
            node=(
                'final: Final SELECT\nfiltered · grouped',
                'src: t{k}',
            ),
            edge=(
                't{k} -> Final SELECT\nfiltered · grouped (dependency)',
            ),
        ),
        Case(
            "tsql", "auto", {},
            'SELECT 1 FROM t{k} SELECT 2 FROM u',
            mode=(
                'flow',
            ),
            node=(
                'start: Script start',
                'stmt: SELECT … FROM t{k}\nSELECT … FROM u',
                'start: End',
            ),
            edge=(
                'Script start -> SELECT … FROM t{k}\nSELECT … FROM u (control)',
                'SELECT … FROM t{k}\nSELECT … FROM u -> End (control)',
            ),
        ),
    ),
    "findings_and_scope": (
        Case(
            "auto", "auto", {},
            'SELECT {k}',
            mode=(
                'flow',
            ),
            finding=(
                'warning dialect_low_confidence document None-None',
                'warning dialect_ambiguous document None-None',
            ),
        ),
        Case(
            "auto", "auto", {},
            'DECLARE @x INT; EXEC dbo.p {k}',
            mode=(
                'flow',
            ),
        ),
        Case(
            "plpgsql", "auto", {},
            "CREATE FUNCTION f() RETURNS int AS $body$ BEGIN EXECUTE 'x{k}'; SELECT (1; END $body$",
            mode=(
                'flow',
            ),
            finding=(
                'error unclosed_parenthesis region 72-73',
                'error missing_end region 76-79',
                'warning dynamic_sql region 48-63',
            ),
        ),
        Case(
            "tsql", "auto", {},
            'CREATE PROCEDURE p AS EXEC(@s{k}); SELECT 1 FROM a CROSS APPLY f({k}); GOTO lost',
            mode=(
                'flow',
            ),
            finding=(
                'warning dynamic_sql region 22-34',
                'warning goto_unresolved region 73-82',
                'warning apply_heuristic region 64-65',
            ),
        ),
        Case(
            "tsql", "auto", {},
            'SELECT 1 FROM OPENJSON(@j{k})',
            mode=(
                'query',
            ),
        ),
    ),
}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def expected(cases: tuple[Case, ...]) -> str:
    values = ", ".join(f"({i}, {quoted(part)}, {quoted(x)})" for i, c in enumerate(cases) for part, x in c.rows())
    return f"""SELECT s_suppkey, part, replace(replace(item, '{{k}}', CAST({NUMBER} AS VARCHAR)), '{{next}}', CAST({NUMBER} + 1 AS VARCHAR)) AS item
FROM supplier JOIN (VALUES {values}) v(k, part, item) ON s_suppkey % {len(cases)} = k"""


def named(part: str, items):
    return F.transform(items, lambda x: F.struct(F.lit(part).alias("part"), x.alias("item")))


def told(case: Case, rows):
    """(s_suppkey, part, item) of the analysed programs of one case."""
    options = Options(**case.options)
    sql = F.replace(F.lit(case.sql), F.lit("{k}"), F.expr(f"cast({NUMBER} as string)"))
    got = analysed(rows.select(F.col("s_suppkey").cast("string").alias("unit_id"), sql.alias("sql")), dialect=case.dialect, mode=case.view, options=options, columns=("mode", "nodes", "edges", "findings"), spread=False)  # the union of cases has tasks enough
    text = F.map_from_arrays(F.col("nodes.id"), F.col("nodes.text"))
    kinds = {
        "mode": F.array(F.col("mode")),
        "node": F.transform("nodes", lambda n: F.concat(n["cls"], F.lit(": "), n["text"])),
        "edge": F.transform("edges", lambda e: F.concat(text[e["src"]], F.lit(" -"), F.coalesce(e["label"], F.lit("")), F.lit("> "), text[e["dst"]], F.lit(" ("), e["kind"], F.lit(")"))),
        "finding": F.transform("findings", lambda f: F.concat_ws(" ", f["severity"], f["code"], f["scope"], F.concat(F.coalesce(f["start"].cast("string"), F.lit("None")), F.lit("-"), F.coalesce(f["end"].cast("string"), F.lit("None"))))),
    }
    parts = F.flatten(F.array(*(named(part, kinds[part]) for part in case.parts())))
    return got.select(F.col("unit_id").cast("long").alias("s_suppkey"), F.explode(parts).alias("x")).select("s_suppkey", "x.part", "x.item")


def register(name: str, cases: tuple[Case, ...]) -> None:
    def run(spark, sf_dir):
        suppliers = table(spark, sf_dir, "supplier").select("s_suppkey")
        out = None
        for i, case in enumerate(cases):
            own = told(case, suppliers.filter(F.col("s_suppkey") % len(cases) == i))
            out = own if out is None else out.unionByName(own)
        return out

    run.__name__ = f"golden_{name}"
    query(expected(cases))(run)


for _name, _cases in FAMILIES.items():
    register(_name, _cases)
