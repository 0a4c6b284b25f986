"""Sources of SQL text, and the split of files into objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lexer import tokens
from ..functions.vocab import OBJECT_KINDS, OBJECT_MODIFIERS

FILES = "file_id string, name string, text string"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file_id, name, text of .sql, .ddl and .txt files under path (folders are searched)."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{sql,ddl,txt}")
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def pasted(spark: SparkSession, text: str, name: str = "Pasted SQL") -> DataFrame:
    return spark.createDataFrame([("pasted", name, text)], FILES)


SAMPLES = {
    "tsql": "CREATE PROCEDURE dbo.close_month @month INT AS\nBEGIN\n  SELECT account, SUM(amount) AS total INTO #due FROM dbo.postings WHERE month = @month GROUP BY account;\n  BEGIN TRY\n    UPDATE b SET b.total = d.total FROM dbo.balance b JOIN #due d ON d.account = b.account;\n  END TRY\n  BEGIN CATCH\n    IF @@TRANCOUNT > 0 ROLLBACK;\n    THROW;\n  END CATCH\nEND",
    "db2": "CREATE PROCEDURE shop.restock (IN item INT)\nLANGUAGE SQL\nBEGIN\n  DECLARE done INT DEFAULT 0;\n  DECLARE CONTINUE HANDLER FOR NOT FOUND SET done = 1;\n  WHILE done = 0 DO\n    UPDATE shop.stock SET amount = amount + 1 WHERE item_id = item;\n  END WHILE;\nEND",
    "plpgsql": "CREATE FUNCTION audit.note(item int) RETURNS void AS $$\nBEGIN\n  INSERT INTO audit.log SELECT item, now();\nEXCEPTION WHEN unique_violation THEN\n  RAISE NOTICE 'known %', item;\nEND $$ LANGUAGE plpgsql",
    "sqlite": "CREATE TRIGGER no_debt BEFORE UPDATE ON account FOR EACH ROW WHEN NEW.total < 0\nBEGIN\n  SELECT RAISE(ABORT, 'no debt');\nEND;",
}


def samples(spark: SparkSession) -> DataFrame:
    """A small object of each dialect."""
    return spark.createDataFrame([(d, f"{d}.sql", t) for d, t in SAMPLES.items()], FILES)


def split_objects(files: DataFrame) -> DataFrame:
    """unit_id, file_id, file, ord, kind, start, end, sql: one row per object, or one SCRIPT for a file without any.

    An object starts at CREATE [OR ALTER|REPLACE] [modifiers] kind, ALTER or REPLACE likewise; its text runs to the next start, and
    the first one's begins with the file. All in windows over the token table, per file.
    """
    toks = tokens(files, "file_id", "text")
    own = Window.partitionBy("file_id").orderBy("ord")
    # of each token, the next one (itself included) that is no modifier: runs of modifiers have any length
    back = Window.partitionBy("file_id").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0)
    toks = toks.select("file_id", "ord", "pos", "u", F.min(F.when(~F.col("u").isin(*OBJECT_MODIFIERS), F.struct("ord", "u"))).over(back).alias("after"))
    both = (F.col("u") == "CREATE") & (F.lead("u", 1).over(own) == "OR") & F.lead("u", 2).over(own).isin("ALTER", "REPLACE")
    toks = toks.withColumn("head", F.when(both, F.lead("after", 3).over(own)).otherwise(F.lead("after", 1).over(own)))
    toks = toks.filter(F.col("u").isin("CREATE", "ALTER", "REPLACE")).select("file_id", "ord", "pos", F.col("head.ord").alias("at"), F.col("head.u").alias("kind")).filter(F.col("kind").isin(*OBJECT_KINDS))
    # a header may hold a second match (REPLACE VIEW inside CREATE OR REPLACE VIEW)
    reach = F.max("at").over(own.rowsBetween(Window.unboundedPreceding, -1))
    starts = toks.withColumn("reach", reach).filter("reach is null or ord > reach")
    starts = starts.select("file_id", (F.row_number().over(own) - 1).alias("ord"), "kind", "pos", F.lead("pos").over(own).alias("next"))
    units = files.select("file_id", F.col("name").alias("file"), F.coalesce("text", F.lit("")).alias("text")).join(starts, "file_id", "left")
    start = F.when(F.coalesce("ord", F.lit(0)) == 0, 0).otherwise(F.col("pos"))
    units = units.withColumns({"start": start, "end": F.coalesce("next", F.length("text")), "ord": F.coalesce("ord", F.lit(0)), "kind": F.coalesce("kind", F.lit("SCRIPT"))})
    sql = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return units.select(F.concat_ws("#", "file_id", "ord").alias("unit_id"), "file_id", "file", "ord", "kind", "start", "end", sql.alias("sql"))
