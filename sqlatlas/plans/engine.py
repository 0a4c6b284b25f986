"""The estate: files in, tables out, every one keyed by unit_id.

    files -> units (JVM) -> analysed (one Arrow stage of Python per object) -> statements, ast, nodes, edges, findings ... (JVM)

``Estate`` plans everything lazily. ``stored`` writes the analysed rows once and rereads them, so that tables derived later do
not parse again; ``register`` publishes temp views.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexer import tokens
from ..functions.render import drawio, mermaid
from ..functions.vocab import DIALECTS
from ..operators.analysis import analyse
from ..operators.flow import Options
from ..operators.layout import layout_reports
from ..sources.catalogue import Catalogue
from ..sources.corpus import split_objects

_NAMES = "array<string>"
_SPAN = "start:int,end:int"
SCHEMAS = {
    "attribution": "struct<total:int,resolved:int,opaque:int,semicolons:int,keywords:int,unresolved:int>",
    "constructs": "array<struct<kind:string,detected:int,resolved:int,opaque:int>>",
    "stats": "map<string,int>",
    "flow_stats": "map<string,int>",
    "statements": f"array<struct<ord:int,kind:string,text:string,{_SPAN},depth:int,tokens:int,reads:{_NAMES},writes:{_NAMES},calls:{_NAMES},result_set:boolean,dynamic:boolean>>",
    "branches": f"array<struct<kind:string,depth:int,{_SPAN}>>",
    "reads": _NAMES,
    "writes": _NAMES,
    "calls": _NAMES,
    "nodes": f"array<struct<ord:int,id:string,shape:string,text:string,cls:string,{_SPAN},lines:{_NAMES},provenance:string,reason:string,object_id:string,resolution:string,resolved:string>>",
    "edges": "array<struct<ord:int,src:string,dst:string,label:string,style:string,kind:string>>",
    "ast": "array<struct<node_id:int,parent_id:int,slot:string,ord:int,depth:int,pre:int,post:int,kind:string,label:string,target:string,tok_lo:int,tok_hi:int,cond_lo:int,cond_hi:int>>",
    "findings": f"array<struct<ord:int,severity:string,code:string,message:string,{_SPAN},scope:string>>",
}
_TEXTS = ("dialect", "detected", "name", "params", "header_kind", "mode", "formula")
_INTS = ("score", *(f"score_{d}" for d in DIALECTS), "tokens_total", "tokens_consumed", "regions", "regions_resolved", "regions_approx", "regions_opaque", "regions_error")
_DOUBLES = ("coverage", "certainty", "confidence", "quality")
TASKS_A_CORE = 4
KINDS = {n: t for names, t in ((_TEXTS, "string"), (_INTS, "int"), (("confident", "tied"), "boolean"), (_DOUBLES, "double")) for n in names} | SCHEMAS


def tasks(spark: SparkSession) -> int:
    """How many tasks slow rows are dealt over."""
    return max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def analysed(units: DataFrame, dialect: str = "auto", mode: str = "auto", options: Options | None = None, catalogue: Catalogue | None = None, columns: Sequence[str] | None = None, spread: bool = True) -> DataFrame:
    """units (unit_id, sql) with the analysis of each; the one Python stage.

    columns: those that are made and leave it (all, unless given); no optimiser can leave them out here.
    spread: deal the units over all cores first. Texts are small and slow to parse, so a scan packs too many of them into one task: a row group of a million rows is a single one.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    held = asdict(options or Options())
    known = units.sparkSession.sparkContext.broadcast(catalogue) if catalogue else None
    wanted = [c for c in KINDS if columns is None or c in columns]
    ddl = ", ".join(["unit_id string", *(f"`{c}` {KINDS[c]}" for c in wanted)])
    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Options(**held)
        cat = known.value if known else None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for unit, sql in zip(part.column("unit_id").to_pylist(), part.column("sql").to_pylist(), strict=True):
                    row = analyse(sql, dialect, mode, own, cat.resolve if cat else None, cat.suffixes if cat else None, wanted)
                    for f in cat.findings if cat and "findings" in row else ():
                        row["findings"].append({"ord": len(row["findings"]), **f._asdict()})
                    row |= {c: list(row[c].items()) for c in ("stats", "flow_stats") if c in row}
                    rows.append({"unit_id": unit, **row})
                yield pa.RecordBatch.from_pylist(rows, schema)

    units = units.select("unit_id", "sql")
    return (units.repartition(tasks(units.sparkSession), "unit_id") if spread else units).mapInArrow(run, ddl)


@dataclass
class Estate:
    files: DataFrame
    dialect: str = "auto"
    mode: str = "auto"
    options: Options = field(default_factory=Options)
    catalogue: Catalogue | None = None
    columns: Sequence[str] | None = None

    def __post_init__(self) -> None:
        self.units = split_objects(self.files)
        self.rows = analysed(self.units, self.dialect, self.mode, self.options, self.catalogue, self.columns)

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession

    def stored(self, path: str) -> Estate:
        """This estate over tables written under path: units and analysed rows."""
        self.units.write.mode("overwrite").parquet(f"{path}/units")
        self.units = self.spark.read.parquet(f"{path}/units")
        analysed(self.units, self.dialect, self.mode, self.options, self.catalogue, self.columns).write.mode("overwrite").parquet(f"{path}/analysed")
        self.rows = self.spark.read.parquet(f"{path}/analysed")
        return self

    def part(self, name: str) -> DataFrame:
        """unit_id with the fields of one nested table: statements, branches, nodes, edges, ast, findings or constructs."""
        return self.rows.select("unit_id", F.explode(name).alias("x")).select("unit_id", "x.*")

    @property
    def objects(self) -> DataFrame:
        """One row per object: id, name, kind, file, scores, and its distinct reads, writes and calls."""
        name = F.coalesce(F.when(F.col("name") != "", F.col("name")), F.when(F.col("kind") == "SCRIPT", F.col("file")), F.concat(F.lit("Script "), F.col("unit_id")))
        kind = F.coalesce(F.when(F.col("header_kind") != "", F.col("header_kind")), F.col("kind"))
        both = self.units.select("unit_id", "file_id", "file", "ord", "kind", "start", "end").join(self.rows, "unit_id")
        return both.withColumns({"name": name, "kind": F.when(kind == "PROC", "PROCEDURE").otherwise(kind)})

    @property
    def references(self) -> DataFrame:
        """unit_id, role (reads, writes, calls), ord, name: one row per distinct name of an object."""
        lists = F.array(*(F.struct(F.lit(r).alias("role"), F.col(r).alias("names")) for r in ("reads", "writes", "calls")))
        return self.rows.select("unit_id", F.explode(lists).alias("l")).select("unit_id", "l.role", F.posexplode("l.names").alias("ord", "name"))

    @property
    def tokens(self) -> DataFrame:
        """The token table of all units: unit_id, ord, kind, v, u, nl, pos, end."""
        return tokens(self.units)

    @property
    def diagnostics(self) -> DataFrame:
        """The findings of all objects, and those of the catalogue once more for the estate (without a unit)."""
        own = self.part("findings")
        if not self.catalogue or not self.catalogue.findings:
            return own
        rows = [(None, i, *f) for i, f in enumerate(self.catalogue.findings)]
        return own.unionByName(self.spark.createDataFrame(rows, own.select("unit_id", "ord", "severity", "code", "message", "start", "end", "scope").schema))

    @property
    def stats(self) -> DataFrame:
        """unit_id, metric, value of the selected graph."""
        return self.rows.select("unit_id", F.explode("stats").alias("metric", "value"))

    def register(self, prefix: str = "estate_") -> None:
        for name in ("statements", "branches", "nodes", "edges", "ast", "findings", "constructs"):
            self.part(name).createOrReplaceTempView(prefix + name)
        for name in ("objects", "references", "stats", "tokens", "diagnostics"):
            getattr(self, name).createOrReplaceTempView(prefix + name)


def health(objects: DataFrame) -> DataFrame:
    """confidence (the least), coverage, diagnostics (not informational) of an estate."""
    bad = F.size(F.filter("findings", lambda f: f["severity"] != "info"))
    return objects.agg(
        F.coalesce(F.min("confidence"), F.lit(0.0)).alias("confidence"),
        F.when(F.count("*") == 0, 0.0).otherwise(F.coalesce(F.sum("tokens_consumed") / F.nullif(F.sum("tokens_total"), F.lit(0)), F.lit(1.0))).alias("coverage"),
        F.coalesce(F.sum(bad), F.lit(0)).alias("diagnostics"),
    )


def construct_coverage(constructs: DataFrame) -> DataFrame:
    """kind, detected, resolved, opaque over all objects."""
    return constructs.groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("detected", "resolved", "opaque")))


def construct_note(constructs: DataFrame) -> DataFrame:
    """One row of text: how many constructs were detected, resolved and opaque, and by kind."""
    by = construct_coverage(constructs)
    one = F.concat(F.col("kind"), F.lit(" "), F.col("resolved"), F.lit("/"), F.col("detected"), F.when(F.col("opaque") > 0, F.concat(F.lit(" · "), F.col("opaque"), F.lit(" opaque"))).otherwise(""))
    lines = F.array_join(F.array_sort(F.collect_list(one)), ", ")
    return by.agg(F.concat_ws("", F.lit("Constructs: "), F.sum("detected"), F.lit(" detected · "), F.sum("resolved"), F.lit(" resolved · "), F.sum("opaque"), F.lit(" opaque — "), lines).alias("note"))


def complexity(objects: DataFrame) -> DataFrame:
    """unit_id, value, band 1 to 4, note: cyclomatic complexity of a flow, moving parts of a query."""
    query = F.col("mode") == "query"
    value = F.when(query, F.col("stats")["parts"]).otherwise(F.col("stats")["cc"])
    scale = F.when(query, F.array(*map(F.lit, (8, 20, 40)))).otherwise(F.array(*map(F.lit, (5, 10, 20))))
    band = 1 + F.size(F.filter(scale, lambda s: F.col("value") > s))
    words = F.when(query, F.array(*map(F.lit, ("short pipeline", "moderate pipeline", "heavy pipeline", "very heavy pipeline")))).otherwise(F.array(*map(F.lit, ("few paths", "moderate branching", "busy; consider splitting", "too many branches to test"))))
    return objects.withColumn("value", value).withColumn("band", band).select("unit_id", "value", "band", F.get(words, F.col("band") - 1).alias("note"))


def confidence_band(c: str = "confidence"):
    return F.when(F.col(c) >= 0.85, "high").when(F.col(c) >= 0.6, "medium").otherwise("low")


def corpus_metrics(rows: DataFrame) -> DataFrame:
    """The rates of a corpus in one row: attribution, unresolved, tail, opaque, fallback, edge kinds, provenance, spans of findings."""

    def rate(a, b):
        return F.when(b == 0, 1.0).otherwise(F.round(a / b, 6))

    a = F.col("attribution")
    counted = rows.select(
        a["total"].alias("total"), (a["resolved"] + a["opaque"] + a["semicolons"] + a["keywords"] + a["unresolved"]).alias("accounted"), a["unresolved"].alias("unresolved"), a["opaque"].alias("opaque"),
        (F.col("tokens_total") - F.col("tokens_consumed")).alias("tail"), F.size("statements").alias("statements"), F.size(F.filter("statements", lambda s: s["kind"] == "unknown")).alias("unknown"),
        F.size("edges").alias("edges"), F.size(F.filter("edges", lambda e: e["kind"].isNotNull())).alias("kinds"), F.size("nodes").alias("nodes"), F.size(F.filter("nodes", lambda n: n["provenance"].isNotNull())).alias("provenance"),
        F.size(F.filter("findings", lambda f: f["scope"] == "region")).alias("regional"), F.size(F.filter("findings", lambda f: (f["scope"] == "region") & (f["start"] >= 0) & (f["end"] > f["start"]))).alias("spanned"),
    )
    s = counted.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counted.columns))
    return s.select(
        rate(F.col("accounted"), F.col("total")).alias("attribution_rate"), rate(F.col("unresolved"), F.col("total")).alias("unresolved_rate"), rate(F.col("tail"), F.col("total")).alias("tail_rate"),
        rate(F.col("opaque"), F.col("total")).alias("opaque_rate"), rate(F.col("unknown"), F.col("statements")).alias("fallback_rate"), rate(F.col("kinds"), F.col("edges")).alias("edge_kind_rate"),
        rate(F.col("provenance"), F.col("nodes")).alias("provenance_rate"), rate(F.col("spanned"), F.col("regional")).alias("finding_span_rate"), "total", "statements",
    )


def export_metrics(rows: DataFrame) -> DataFrame:
    """One row of rates over all objects with a graph: parity (Mermaid and draw.io hold the same nodes and edges, in both directions), traced (draw.io
    nodes that tell their provenance), layout (no overlaps, every edge of the backbone that closes no cycle goes on by layers)."""
    rows = rows.filter(F.size("nodes") > 0).select("unit_id", "nodes", "edges")
    parts = []
    for direction in ("TD", "LR"):
        lines = F.split(mermaid(F.col("nodes"), F.col("edges"), direction), "\n")
        drawn = drawio(rows, direction).select("unit_id", *(F.regexp_count("xml", F.lit(f' {k}="1" ')).alias(k) for k in ("vertex", "edge")), F.regexp_count("xml", F.lit('data-origin="cls=[^"]*provenance=')).alias("traced"))
        told = rows.select("unit_id", F.size(F.filter(lines, lambda x: x.rlike(r"^  n[0-9]+ -"))).alias("wires"), F.size(F.filter(lines, lambda x: x.rlike(r"^  n[0-9]+[^ ]"))).alias("shapes"))
        same = (F.col("vertex") == F.col("shapes")) & (F.col("edge") == F.col("wires"))
        parts.append(told.join(drawn, "unit_id").select(same.cast("int").alias("parity"), "vertex", "traced"))
    exports = parts[0].unionByName(parts[1]).agg(F.round(F.avg("parity"), 6).alias("parity_rate"), F.round(F.sum("traced") / F.sum("vertex"), 6).alias("traced_rate"))
    fine = (F.col("overlaps") == 0) & (F.col("monotonic_edges") + F.col("back_edges") >= F.col("backbone_edges"))
    laid = layout_reports(rows).agg(F.round(F.avg(fine.cast("int")), 6).alias("layout_rate"))
    one = F.lit(1).alias("one")
    return exports.select("*", one).join(laid.select("*", one), "one").drop("one")


def metrics_snapshot(rows: DataFrame) -> str:
    """``corpus_metrics`` as sorted JSON, to be stored and compared."""
    return json.dumps(corpus_metrics(rows).first().asDict(), sort_keys=True, default=float, indent=2)


def verify_snapshot(rows: DataFrame, stored: str) -> None:
    """Raises if the stored snapshot is stale."""
    now = metrics_snapshot(rows)
    if json.loads(now) != json.loads(stored):
        raise ValueError(f"the stored metrics are stale; now:\n{now}")
