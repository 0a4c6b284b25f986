"""Dialect detection: weighted rules over the raw text, as one column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vocab import DIALECT_RULES, DIALECTS, WHOLE_TEXT_RULES


def scores(text: Column) -> dict[str, Column]:
    out = {d: F.lit(0) for d in DIALECTS}
    for i, (dialect, weight, pattern, fold) in enumerate(DIALECT_RULES):
        rule = ("(?i)" if fold else "") + (rf"\A(?:{pattern})" if i in WHOLE_TEXT_RULES else pattern)
        out[dialect] = out[dialect] + F.when(text.rlike(rule), weight).otherwise(0)
    return out


def detect(texts: DataFrame, text: str = "sql") -> DataFrame:
    """texts with score_<dialect>, dialect, score, confident, tied, certainty."""
    found = scores(F.coalesce(F.col(text), F.lit("")))
    out = texts.withColumns({f"score_{d}": s for d, s in found.items()})
    own = [F.col(f"score_{d}") for d in DIALECTS]
    out = out.withColumn("score", F.greatest(*own))
    winner = F.lit("tsql")
    for d in reversed(DIALECTS):
        winner = F.when((F.col("score") > 0) & (F.col(f"score_{d}") == F.col("score")), d).otherwise(winner)
    tied = sum((c == F.col("score")).cast("int") for c in own) >= 2
    return out.withColumns({"dialect": winner, "confident": F.col("score") >= 4, "tied": tied, "certainty": F.least(F.lit(1.0), F.col("score") / 7)})
