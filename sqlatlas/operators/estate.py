"""The object dependency graph of an estate, its statistics, and filtered views; joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.catalogue import normal_column

_KINDS = {"calls": "call", "writes": "data", "reads": "dependency"}


def _by_role(values: dict[str, str], role: str = "role") -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(F.col(role) == k, v).otherwise(out)
    return out


def dependency_graph(objects: DataFrame, references: DataFrame, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges). A reference meets the last object of its name, or an external target of its role and name.

    nodes: id, text, cls, shape, object_id, provenance, reason, resolution, resolved; edges: src, dst, label, style, kind, unit_id, role, ord.
    """
    named = objects.select("unit_id", "file_id", "ord", "name", "kind", F.upper("name").alias("key"))
    last = named.groupBy("key").agg(F.max_by("unit_id", F.struct("file_id", "ord")).alias("target"))
    cls = F.when(F.col("kind") == "VIEW", "cte").when(F.col("kind") == "SCRIPT", "final").otherwise("call")
    none = F.lit(None).cast("string")
    own = named.select(
        F.concat(F.lit("o:"), "unit_id").alias("id"), F.concat_ws("\n", "name", "kind").alias("text"), cls.alias("cls"), F.lit("rect").alias("shape"),
        F.col("unit_id").alias("object_id"), F.lit("source").alias("provenance"), none.alias("reason"), none.alias("resolution"), none.alias("resolved"),
    )
    owners = last.select("key", F.concat(F.lit("o:"), "target").alias("own"))
    froms = named.select("unit_id", "key").join(owners, "key").select("unit_id", F.col("own").alias("src"))
    refs = references.withColumn("key", F.upper("name")).join(owners, "key", "left")
    refs = refs.withColumn("dst", F.coalesce("own", F.concat_ws(":", F.lit("x"), "role", "key")))

    # the spelling and rank of an external target are its first one's
    first = refs.filter("own is null").groupBy("role", "key").agg(F.min_by("name", F.struct("unit_id", "ord")).alias("name"))
    temp, remote = F.col("name").startswith("#"), F.size(F.split("name", r"\.")) >= 3
    if index is not None:
        first = first.withColumn("norm", normal_column(F.col("name"))).join(index, "norm", "left")
    else:
        first = first.withColumns({"resolution": none, "canonical": none})
    sure, clash = (F.col("resolution") == "verified") & ~temp, (F.col("resolution") == "conflict") & ~temp
    outer = first.select(
        F.concat_ws(":", F.lit("x"), "role", "key").alias("id"),
        F.when(sure, F.col("canonical")).when(remote & ~temp, F.concat(F.lit("external: "), "name")).otherwise(F.col("name")).alias("text"),
        F.when((F.col("role") == "calls") & ~temp, "call").otherwise("src").alias("cls"), F.when((F.col("role") == "calls") & ~temp, "rect").otherwise("io").alias("shape"),
        F.when(~temp, F.col("name")).alias("object_id"), F.when(temp, "synthetic").otherwise("external").alias("provenance"),
        F.when(temp, "temporary table placeholder").when(clash, "conflicting catalogue evidence; identity unresolved").alias("reason"),
        F.when(sure | clash, F.col("resolution")).alias("resolution"), F.when(sure, F.col("canonical")).alias("resolved"),
    )
    edges = refs.join(froms, "unit_id").select("src", "dst", F.col("role").alias("label"), F.when(F.col("role") == "writes", "dotted").otherwise("solid").alias("style"), _by_role(_KINDS).alias("kind"), "unit_id", "role", "ord")
    return own.unionByName(outer), edges


def estate_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """objects, reads, writes, calls, external (temporary ones too) in one row."""
    n = nodes.agg(F.coalesce(F.count_if(F.col("id").startswith("o:")), F.lit(0)).alias("objects"), F.coalesce(F.count_if(F.col("id").startswith("x:")), F.lit(0)).alias("external"))
    e = edges.agg(*(F.coalesce(F.count_if(F.col("role") == r), F.lit(0)).alias(r) for r in ("reads", "writes", "calls")))
    return n.withColumn("one", F.lit(1)).join(e.withColumn("one", F.lit(1)), "one").drop("one")


def filtered(nodes: DataFrame, edges: DataFrame, reads: bool = True, writes: bool = True, calls: bool = True, external: bool = True, temp: bool = True, focus: str = "") -> tuple[DataFrame, DataFrame]:
    """The part of a dependency graph to show; the graph itself is not changed.

    A focus keeps nodes whose text or object id contains it, and their neighbours over all edges, among the nodes kept.
    """
    keep = nodes.filter(~((F.col("provenance") == "external") & F.lit(not external)) & ~((F.col("provenance") == "synthetic") & F.lit(not temp)))
    focus = focus.strip().upper()
    if focus:
        hit = keep.filter(F.upper("text").contains(focus) | F.upper(F.coalesce("object_id", F.lit(""))).contains(focus)).select("id")
        near = edges.join(hit, edges["src"] == hit["id"], "left_semi").select(F.col("dst").alias("id")).union(edges.join(hit, edges["dst"] == hit["id"], "left_semi").select(F.col("src").alias("id")))
        keep = keep.join(hit.union(near).distinct(), "id", "left_semi")
    shown = [k for k, on in (("data", writes), ("call", calls), ("dependency", reads)) if on]
    passed = edges.filter(F.col("kind").isin(*shown) | ~F.col("kind").isin("data", "call", "dependency")) if shown else edges.filter(~F.col("kind").isin("data", "call", "dependency"))
    ids = keep.select("id")
    passed = passed.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return keep, passed


def distinct_names(names: DataFrame, keys: list[str], name: str = "name", order: str = "ord") -> DataFrame:
    """Case-insensitive distinct: the first spelling in order."""
    w = Window.partitionBy(*keys, F.upper(name)).orderBy(order)
    return names.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def unresolved_gotos(ast: DataFrame) -> DataFrame:
    """goto rows of the tree whose label their object does not declare."""
    labels = ast.filter("kind = 'label'").select("unit_id", F.upper("label").alias("to")).distinct()
    return ast.filter("kind = 'goto'").withColumn("to", F.upper("label")).join(labels, ["unit_id", "to"], "left_anti")


def unresolved_breaks(ast: DataFrame) -> DataFrame:
    """break and continue rows whose target labels no loop around them (containment of pre and post)."""
    jumps = ast.filter("kind in ('break', 'continue') and target is not null")
    loops = ast.filter("kind in ('while', 'for', 'loop', 'repeat') and label is not null").select("unit_id", F.upper("label").alias("to"), F.col("pre").alias("lo"), F.col("post").alias("hi"))
    j, o = jumps.withColumn("to", F.upper("target")).alias("j"), loops.alias("o")
    return j.join(o, (F.col("j.unit_id") == F.col("o.unit_id")) & (F.col("j.to") == F.col("o.to")) & (F.col("o.lo") < F.col("j.pre")) & (F.col("o.hi") > F.col("j.post")), "left_anti")


def region_status(regions: DataFrame, findings: DataFrame) -> DataFrame:
    """regions (unit_id, ord, kind, start, end) with status: an interval-overlap join with findings, inside each object."""
    f = findings.filter("scope = 'region' and start is not null").select("unit_id", "severity", F.col("start").alias("lo"), F.col("end").alias("hi"))
    r = regions.alias("r").join(f.alias("f"), (F.col("r.unit_id") == F.col("f.unit_id")) & (F.col("f.lo") < F.col("r.end")) & (F.col("f.hi") > F.col("r.start")), "left")
    worst = F.max(F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0))
    r = r.groupBy("r.unit_id", "r.ord", "r.kind").agg(F.coalesce(worst, F.lit(0)).alias("worst"))
    status = F.when(F.col("worst") == 2, "error").when(F.col("kind").isin("dynamic", "unknown"), "opaque").when(F.col("worst") == 1, "approx").otherwise("resolved")
    return r.select("unit_id", "ord", "kind", status.alias("status"))
