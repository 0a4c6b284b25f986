"""SQL functions: parse and look at SQL text from SQL itself."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.analysis import analyse


@udtf(returnType="ord int, kind string, text string, depth int, reads array<string>, writes array<string>, calls array<string>")
class SqlStatements:
    """sql_statements(sql, dialect): one row per statement."""

    def eval(self, sql: str, dialect: str):
        for s in analyse(sql, dialect or "auto")["statements"]:
            yield s["ord"], s["kind"], s["text"], s["depth"], s["reads"], s["writes"], s["calls"]


@udtf(returnType="severity string, code string, message string, start int, end int")
class SqlFindings:
    """sql_findings(sql, dialect): one row per finding."""

    def eval(self, sql: str, dialect: str):
        for f in analyse(sql, dialect or "auto")["findings"]:
            yield f["severity"], f["code"], f["message"], f["start"], f["end"]


def register(spark: SparkSession) -> None:
    spark.udtf.register("sql_statements", SqlStatements)
    spark.udtf.register("sql_findings", SqlFindings)
