"""Workspace snapshots: versioned JSON of files, options and catalogue; parsed, repaired, stored as a table.

``parse_workspaces`` works on any number of snapshots at once, in JSON functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 2
#: Each choice with its values, the default first.
CHOICES = {
    "dialect": ("auto", "tsql", "db2", "plpgsql", "sqlite"),
    "scope": ("internal", "dependencies"),
    "view": ("auto", "flow", "query"),
    "detail": ("summary", "full"),
    "dir": ("TD", "LR"),
}
FLAGS = {"group": True, "number": False, "fanIn": False, "sources": True}
_FILES = "array<struct<name:string,text:string>>"


def _truthy(v: Column) -> Column:
    """JSON truth: null, false, 0 and the empty string are false."""
    return v.isNotNull() & ~v.isin("false", "0", "", "null")


def parse_workspaces(rows: DataFrame, json: str = "json") -> DataFrame:
    """rows with error (corrupt_json, not_workspace, empty_workspace or null), migrated, and the repaired fields."""
    j = F.col(json)
    raw = F.try_parse_json(F.coalesce(j, F.lit("")))
    kind = F.schema_of_variant(raw)

    def field(path: str, kind: str = "string") -> Column:
        return F.try_variant_get(raw, f"$.{path}", kind)

    files = F.filter(F.coalesce(field("files", "array<variant>"), F.expr("array()")), lambda f: F.schema_of_variant(F.try_variant_get(f, "$.name", "variant")).eqNullSafe("STRING") & F.try_variant_get(f, "$.text", "variant").isNotNull())
    files = F.transform(files, lambda f: F.struct(F.try_variant_get(f, "$.name", "string").alias("name"), F.coalesce(F.try_variant_get(f, "$.text", "string"), F.lit("null")).alias("text")))
    version = F.when(F.schema_of_variant(F.try_variant_get(raw, "$.version", "variant")).isin("BIGINT", "DOUBLE", "DECIMAL(1,0)"), field("version", "double"))
    active = field("activeObjectId")
    out = {
        "kind": kind,
        "version": F.lit(VERSION),
        "migrated": ~F.coalesce(version == VERSION, F.lit(False)),
        "files": files,
        "savedAt": field("savedAt"),
        "catalogue": field("catalogue"),
        "activeObjectId": F.when(_truthy(active), active),
    }
    for name, values in CHOICES.items():
        out[name] = F.when(field(f"options.{name}").isin(*values), field(f"options.{name}")).otherwise(F.lit(values[0]))
    for name, default in FLAGS.items():
        given = F.try_variant_get(raw, f"$.options.{name}", "variant")
        out[name] = F.when(given.isNull(), F.lit(default)).otherwise(_truthy(field(f"options.{name}")))
    rows = rows.withColumns(out)
    error = F.when(raw.isNull(), "corrupt_json").when(~F.coalesce(F.col("kind").startswith("OBJECT"), F.lit(False)), "not_workspace").when((F.size("files") == 0) & F.col("activeObjectId").isNull(), "empty_workspace")
    return rows.withColumn("error", error).drop("kind")


def serialize(rows: DataFrame) -> DataFrame:
    """rows with json: snapshots in their normal form."""
    options = F.struct(*CHOICES, *FLAGS)
    whole = F.struct(F.lit(VERSION).alias("version"), "savedAt", "files", options.alias("options"), "catalogue", "activeObjectId")
    return rows.withColumn("json", F.to_json(whole, {"ignoreNullFields": "false"}))


def snapshot(spark: SparkSession, files: list[tuple[str, str]], options: dict | None = None, catalogue: str | None = None, active: str | None = None) -> DataFrame:
    """A one-row frame of the present state, with the time of saving."""
    options = {k: v[0] for k, v in CHOICES.items()} | FLAGS | (options or {})
    row = spark.createDataFrame([(files, catalogue, active)], f"files {_FILES}, catalogue string, activeObjectId string")
    return row.withColumns({"savedAt": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), **{k: F.lit(v) for k, v in options.items()}})


def save(rows: DataFrame, path: str) -> None:
    serialize(rows).select("json").coalesce(1).write.mode("overwrite").text(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def clear(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The saved snapshot, repaired; a corrupt one is removed and gives None."""
    if not exists(spark, path):
        return None
    rows = parse_workspaces(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))
    if rows.filter("error is null").isEmpty():
        clear(spark, path)
        return None
    return rows


def export_text(spark: SparkSession, path: str) -> str:
    rows = load(spark, path)
    return serialize(rows).first()["json"] if rows is not None else ""
