"""Vocabularies of the four analysed dialects. They decide results and are stated as they must be."""

DIALECTS = ("tsql", "db2", "plpgsql", "sqlite")
DIALECT_NAMES = {"tsql": "T-SQL", "db2": "DB2 SQL PL", "plpgsql": "PL/pgSQL", "sqlite": "SQLite"}


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


_HARD = _words("BEGIN END IF ELSE WHILE RETURN")
HARD = {
    "tsql": _HARD | _words("BREAK CONTINUE GOTO THROW GO"),
    "db2": _HARD | _words("ELSEIF LEAVE ITERATE GOTO REPEAT UNTIL THEN DO"),
    "plpgsql": _HARD | _words("ELSIF EXIT CONTINUE EXCEPTION THEN LOOP"),
    "sqlite": _HARD,
}
#: May start a statement.
SOFT = _words(
    "SELECT INSERT UPDATE DELETE MERGE EXEC EXECUTE SET DECLARE PRINT RAISERROR TRUNCATE OPEN CLOSE FETCH DEALLOCATE COMMIT ROLLBACK "
    "SAVE SAVEPOINT RELEASE WAITFOR CREATE ALTER DROP USE WITH GRANT REVOKE DENY RESTORE BACKUP CALL PERFORM RAISE SIGNAL RESIGNAL GET "
    "PREPARE ASSERT COPY ANALYZE VACUUM PRAGMA REPLACE ATTACH DETACH REINDEX EXPLAIN VALUES REFRESH LISTEN NOTIFY CASE"
)
#: A statement that ends in one of these goes on.
CONTINUES = _words(
    "AS FROM INTO UNION ALL EXCEPT INTERSECT AND OR NOT THEN WHEN FOR IS IN EXISTS ON BY WITH SET VALUES OUTPUT TOP APPLY JOIN LIKE "
    "BETWEEN CASE ELSE OVER PARTITION ORDER GROUP HAVING DISTINCT PERCENT CROSS OUTER INNER LEFT RIGHT FULL USING RETURNING LIMIT OFFSET DO CONFLICT"
)
CONTINUING_OPS = frozenset([",", "(", "=", "<", ">", "<=", ">=", "<>", "!=", "+", "-", "*", "/", "||", ".", "%", "::"])
OPENERS = _words("THEN DO LOOP")
BLOCK_STOPS = _words("END ELSE ELSEIF ELSIF EXCEPTION UNTIL WHEN")
OBJECT_KINDS = ("PROCEDURE", "PROC", "FUNCTION", "TRIGGER", "VIEW")
OBJECT_MODIFIERS = _words("TEMP TEMPORARY MATERIALIZED UNIQUE CLUSTERED")
NAME_STOPS = _words("AS WITH ON FOR AFTER INSTEAD BEFORE RETURNS LANGUAGE BEGIN IF NOT EXISTS")

SOURCE_OPENERS = _words("FROM JOIN APPLY USING")
SOURCE_LIST_ENDS = _words("WHERE GROUP HAVING ORDER LIMIT OFFSET FETCH RETURNING UNION EXCEPT INTERSECT INTO FOR ON")
TABULAR_FUNCTIONS = _words("UNNEST XMLTABLE JSON_TABLE GENERATE_SERIES")
QUERY_HEADS = _words("SELECT INSERT UPDATE DELETE MERGE REPLACE COPY")
CALL_HEADS = _words("EXEC EXECUTE CALL PERFORM")
RAISE_LEVELS = _words("NOTICE WARNING INFO DEBUG LOG")
IGNORED_KEYWORDS = _words("BEGIN END THEN ELSE ELSEIF ELSIF DO LOOP WHEN EXCEPTION UNTIL TRY CATCH ATOMIC NOT")

PG_ERROR_CODES = {
    "RAISE_EXCEPTION": "P0001",
    "NO_DATA_FOUND": "P0002",
    "TOO_MANY_ROWS": "P0003",
    "ASSERT_FAILURE": "P0004",
    "QUERY_CANCELED": "57014",
    "DIVISION_BY_ZERO": "22012",
    "NUMERIC_VALUE_OUT_OF_RANGE": "22003",
    "INVALID_TEXT_REPRESENTATION": "22P02",
    "INTEGRITY_CONSTRAINT_VIOLATION": "23000",
    "RESTRICT_VIOLATION": "23001",
    "NOT_NULL_VIOLATION": "23502",
    "FOREIGN_KEY_VIOLATION": "23503",
    "UNIQUE_VIOLATION": "23505",
    "CHECK_VIOLATION": "23514",
    "EXCLUSION_VIOLATION": "23P01",
}

#: (dialect, weight, pattern, case-insensitive); Java and Python read the patterns alike.
DIALECT_RULES = (
    ("plpgsql", 4, r"\$\$|\$[a-z_]+\$", True),
    ("plpgsql", 7, r"LANGUAGE\s+'?plpgsql", True),
    ("plpgsql", 3, r"\bELSIF\b", True),
    ("plpgsql", 4, r"\bRAISE\s+(NOTICE|EXCEPTION|WARNING|INFO|DEBUG|LOG|USING)\b", True),
    ("plpgsql", 4, r"\bPERFORM\b|\bRETURN\s+(NEXT|QUERY)\b", True),
    ("plpgsql", 4, r"\bEXCEPTION\s+WHEN\b", True),
    ("plpgsql", 1, r"::\s*[A-Za-z0-9_]", False),
    ("db2", 4, r"\bELSEIF\b", True),
    ("db2", 2, r"\bEND\s+(WHILE|REPEAT|FOR)\b", True),
    ("db2", 6, r"\bDECLARE\s+(CONTINUE|EXIT|UNDO)\s+HANDLER\b", True),
    ("db2", 4, r"\bSIGNAL\s+SQLSTATE\b|\bRESIGNAL\b|\bITERATE\b", True),
    ("db2", 3, r"(?s)(?!.*plpgsql).*\bLANGUAGE\s+SQL\b", True),
    ("db2", 2, r"\bSPECIFIC\b|\bDYNAMIC\s+RESULT\s+SETS\b|\bSYSIBM\b|\bSYSCAT\b|\bVALUES\s+INTO\b", True),
    ("tsql", 3, r"@[A-Za-z0-9_]", False),
    ("tsql", 7, r"\bBEGIN\s+TRY\b|\bBEGIN\s+CATCH\b", True),
    ("tsql", 3, r"\bSET\s+NOCOUNT\b|\bRAISERROR\b|\bsp_[A-Za-z0-9_]|\bdbo\.|\bEXEC(UTE)?\s+[A-Za-z0-9_]", True),
    ("tsql", 2, r"\[[A-Za-z_#@]", False),
    ("tsql", 3, r"(?m)^\s*GO\s*;?\s*$", True),
    ("sqlite", 5, r"\bAUTOINCREMENT\b|\bPRAGMA\b|\bsqlite_|\bINSERT\s+OR\s+(REPLACE|IGNORE)\b", True),
    ("sqlite", 7, r"\bRAISE\s*\(\s*(IGNORE|FAIL|ABORT|ROLLBACK)\b", True),
    ("sqlite", 2, r"(?s)(?!.*\b(DECLARE|LANGUAGE)\b)(?=.*\bFOR\s+EACH\s+ROW\b).*\bCREATE\s+TRIGGER\b", True),
)
#: Rules that read the whole text must begin at its start.
WHOLE_TEXT_RULES = (11, 20)

CATALOGUE_KINDS = ("TABLE", "VIEW", "PROC", "FUNCTION", "TRIGGER", "SYNONYM", "TYPE", "SEQUENCE")
