"""Graphs as text: Mermaid and draw.io, per row, from nested nodes and edges; prompts. Column expressions only."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vocab import DIALECT_NAMES

MOST_SQL = 40_000

# fixed values: Mermaid's character codes, in the order in which they must be replaced
MERMAID_CODES = (("#", "#35;"), ("&", "#amp;"), ('"', "#quot;"), ("<", "#lt;"), (">", "#gt;"), ("|", "#124;"), ("%%", "#37;#37;"))
XML_CODES = (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"))
WRAPS = {"rect": ('["', '"]'), "diamond": ('{"', '"}'), "hex": ('{{"', '"}}'), "round": ('(["', '"])'), "marker": ('>"', '"]'), "io": ('[("', '")]'), "call": ('[["', '"]]')}

#: Fill, stroke and font colour of every node class.
STYLES = {
    "start": ("#e5e7eb", "#6b7280", "#111827"), "stmt": ("#ffffff", "#6b7280", "#111827"), "notice": ("#f3f4f6", "#9ca3af", "#374151"),
    "io": ("#e0f2fe", "#0284c7", "#0c4a6e"), "cursor": ("#cffafe", "#0891b2", "#164e63"), "call": ("#ede9fe", "#7c3aed", "#2e1065"),
    "tran": ("#d1fae5", "#059669", "#064e3b"), "cond": ("#fef9c3", "#ca8a04", "#422006"), "loop": ("#e0e7ff", "#4f46e5", "#1e1b4b"),
    "try": ("#dcfce7", "#15803d", "#14532d"), "catch": ("#ffe4e6", "#e11d48", "#4c0519"), "ret": ("#ecfccb", "#65a30d", "#1a2e05"),
    "err": ("#fecaca", "#b91c1c", "#450a0a"), "halt": ("#fed7aa", "#c2410c", "#431407"), "opaque": ("#e7e5e4", "#57534e", "#1c1917"),
    "flowctl": ("#fae8ff", "#a21caf", "#4a044e"), "cte": ("#dbeafe", "#2563eb", "#172554"), "src": ("#f5f5f4", "#78716c", "#292524"), "final": ("#fef3c7", "#d97706", "#451a03"),
}
#: Line style, colour and width of every edge kind.
EDGE_STYLES = {"control": ("solid", "#6b7280", 1), "exception": ("dotted", "#b91c1c", 1), "data": ("solid", "#059669", 2), "dependency": ("solid", "#6b7280", 1), "call": ("solid", "#7c3aed", 1)}
_SHAPES = {"round": "ellipse;perimeter=ellipsePerimeter;", "diamond": "rhombus;perimeter=rhombusPerimeter;", "hex": "shape=hexagon;perimeter=hexagonPerimeter2;"}
_CYLINDER, _PROCESS, _MARKER, _BOX = "shape=cylinder3;boundedLbl=1;backgroundOutline=1;", "shape=process;", "rounded=1;arcSize=20;dashed=1;", "rounded=1;arcSize=8;"


def escaped_label(text: Column) -> Column:
    text = text.cast("string")
    for plain, code in MERMAID_CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    text = F.regexp_replace(text, r"[\r\n]+", " ")
    return F.regexp_replace(F.replace(text, F.lit("\x01"), F.lit("<BR>")), r"\s+", " ")


def xml_attribute(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    for plain, code in XML_CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return F.regexp_replace(text, r"[\r\n]+", "&#xa;")


def _choose(key: Column, values: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def _lines(n: Column) -> Column:
    return F.coalesce(n["lines"], F.split(F.replace(n["text"], F.lit("\x01"), F.lit("\n")), "\n"))


def _tagged(tag: str, value: Column) -> Column:
    return F.when(value.isNotNull() & (value.cast("string") != ""), F.concat(F.lit(tag + "="), value.cast("string")))


def metadata(n: Column) -> Column:
    """Where a node comes from, as words."""
    where = F.when(n["start"].isNotNull(), F.concat_ws("-", n["start"].cast("string"), n["end"].cast("string")))
    return F.concat_ws(" ", _tagged("provenance", n["provenance"]), _tagged("span", where), _tagged("object", n["object_id"]), _tagged("resolution", n["resolution"]), _tagged("resolved", n["resolved"]), _tagged("reason", n["reason"]))


def _dashed(e: Column) -> Column:
    return (e["style"] == "dotted") | (e["kind"] == "exception")


def mermaid(nodes: Column, edges: Column, direction: str = "TD") -> Column:
    """A flowchart: nodes, edges, data-edge styles, provenance comments and classes."""

    def node(n: Column) -> Column:
        shape = F.when((n["shape"] == "rect") & n["cls"].isin("io", "call"), n["cls"]).otherwise(n["shape"])
        label = F.array_join(F.transform(_lines(n), escaped_label), "<br/>")
        return F.concat(F.lit("  "), n["id"], _choose(shape, {k: a for k, (a, _) in WRAPS.items()}, WRAPS["rect"][0]), label, _choose(shape, {k: b for k, (_, b) in WRAPS.items()}, WRAPS["rect"][1]))

    def edge(e: Column) -> Column:
        label = F.when(F.coalesce(e["label"], F.lit("")) != "", F.concat(F.lit("|"), escaped_label(e["label"]), F.lit("|"))).otherwise("")
        return F.concat(F.lit("  "), e["src"], F.lit(" "), F.when(_dashed(e), "-.->").otherwise("-->"), label, F.lit(" "), e["dst"])

    places = F.filter(F.transform(edges, lambda e, i: F.when(e["kind"] == "data", i.cast("string"))), lambda x: x.isNotNull())
    data = F.when(F.size(places) > 0, F.array(F.concat(F.lit("  linkStyle "), F.array_join(places, ","), F.lit(f" stroke:{EDGE_STYLES['data'][1]},stroke-width:{EDGE_STYLES['data'][2]}px;")))).otherwise(F.expr("cast(array() as array<string>)"))
    notes = F.concat(F.array(F.lit("%% provenance")), F.transform(nodes, lambda n: F.concat(F.lit("%% "), n["id"], F.lit(":"), n["cls"], F.lit(" "), metadata(n))))
    # classes in the order of their first node
    used = F.filter(F.array_distinct(F.transform(nodes, lambda n: n["cls"])), lambda c: c.isin(*STYLES))

    def style(c: Column) -> Column:
        name = F.concat(F.lit("cls"), F.initcap(c))
        look = _choose(c, {k: f"fill:{f},stroke:{s},color:{t}" for k, (f, s, t) in STYLES.items()}, "")
        ids = F.array_join(F.transform(F.filter(nodes, lambda n: n["cls"] == c), lambda n: n["id"]), ",")
        return F.concat(F.lit("  classDef "), name, F.lit(" "), look, F.lit(",stroke-width:1px;\n  class "), ids, F.lit(" "), name, F.lit(";"))

    return F.array_join(F.concat(F.array(F.lit(f"flowchart {direction}")), F.transform(nodes, node), F.transform(edges, edge), data, notes, F.transform(used, style)), "\n")


def node_style(n: Column) -> Column:
    look = _choose(n["cls"], {k: f"fillColor={f};strokeColor={s};fontColor={t};" for k, (f, s, t) in STYLES.items()}, "fillColor=#ffffff;strokeColor=#6b7280;fontColor=#111827;")
    shape = F.coalesce(_choose(n["shape"], _SHAPES, None), F.when((n["shape"] == "io") | n["cls"].isin("io", "src"), _CYLINDER).when((n["shape"] == "call") | (n["cls"] == "call"), _PROCESS).when(n["shape"] == "marker", _MARKER).otherwise(_BOX))
    return F.concat(F.lit("whiteSpace=wrap;html=0;align=center;verticalAlign=middle;fontSize=13;strokeWidth=1.5;"), look, shape)


def drawio(rows: DataFrame, direction: str = "TD", title: str = "diagram") -> DataFrame:
    """unit_id, xml: an mxGraph file per row of (unit_id, nodes, edges), laid out."""
    from ..operators.layout import graphs, lay_out, waypoints

    point = pa.struct([("x", pa.int32()), ("y", pa.int32())])
    box = pa.struct([("x", pa.int32()), ("y", pa.int32()), ("w", pa.int32()), ("h", pa.int32())])
    kind = pa.struct([("at", pa.list_(box)), ("lanes", pa.list_(pa.list_(point)))])

    def near(v: float) -> int:
        return int(v // 1 + (v % 1 >= 0.5))

    def place(nodes: list[dict], edges: list[dict]) -> dict:
        spots = lay_out(nodes, edges, direction)[0] if nodes else []
        lanes = waypoints(spots, edges, direction)
        return {"at": [{"x": near(r["x"]), "y": near(r["y"]), "w": r["w"], "h": r["h"]} for r in spots], "lanes": [[{"x": x, "y": y} for x, y in lanes.get(i, [])] for i in range(len(edges))]}

    def run(batches):
        for batch in batches:
            placed = [place(n or [], e or []) for n, e in graphs(batch)]
            yield batch.append_column("p", pa.array(placed, kind))

    rows = rows.select("unit_id", "nodes", "edges")
    placed = "struct<at:array<struct<x:int,y:int,w:int,h:int>>,lanes:array<array<struct<x:int,y:int>>>>"
    rows = rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + f", p {placed}")

    def vertex(n: Column, i: Column) -> Column:
        at = F.get(F.col("p.at"), i)
        meta = F.concat(F.lit("cls="), n["cls"], F.lit(" "), metadata(n))
        return F.concat(
            F.lit('<mxCell id="v-'), xml_attribute(n["id"]), F.lit('" value="'), xml_attribute(F.array_join(_lines(n), "\n")), F.lit('" style="'), xml_attribute(node_style(n)), F.lit('" vertex="1" parent="1" data-origin="'), xml_attribute(meta),
            F.lit('"><mxGeometry x="'), at["x"].cast("string"), F.lit('" y="'), at["y"].cast("string"), F.lit('" width="'), at["w"].cast("string"), F.lit('" height="'), at["h"].cast("string"), F.lit('" as="geometry"/></mxCell>'),
        )

    def wire(e: Column, i: Column) -> Column:
        look = F.concat(F.lit("edgeStyle=orthogonalEdgeStyle;rounded=1;jettySize=auto;html=0;endArrow=block;endFill=1;"), _choose(e["kind"], {k: f"strokeColor={c};strokeWidth={w};" for k, (_, c, w) in EDGE_STYLES.items()}, "strokeColor=#6b7280;"), F.when(_dashed(e), "dashed=1;").otherwise(""))
        lane = F.get(F.col("p.lanes"), i)
        points = F.array_join(F.transform(lane, lambda q: F.concat(F.lit('<mxPoint x="'), q["x"].cast("string"), F.lit('" y="'), q["y"].cast("string"), F.lit('"/>'))), "")
        inner = F.when(F.size(lane) > 0, F.concat(F.lit('<mxGeometry relative="1" as="geometry"><Array as="points">'), points, F.lit("</Array></mxGeometry>"))).otherwise('<mxGeometry relative="1" as="geometry"/>')
        return F.concat(F.lit('<mxCell id="e-'), (i + 1).cast("string"), F.lit('" value="'), xml_attribute(e["label"]), F.lit('" style="'), look, F.lit('" edge="1" parent="1" source="v-'), xml_attribute(e["src"]), F.lit('" target="v-'), xml_attribute(e["dst"]), F.lit('" data-kind="'), xml_attribute(e["kind"]), F.lit('">'), inner, F.lit("</mxCell>"))

    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<mxfile><diagram name="'), xml_attribute(F.lit(title)), F.lit('"><mxGraphModel grid="1" gridSize="10" page="1"><root>\n<mxCell id="0"/>\n<mxCell id="1" parent="0"/>'))
    body = F.concat(F.transform("nodes", vertex), F.transform("edges", wire))
    return rows.select("unit_id", F.array_join(F.concat(F.array(head), body, F.array(F.lit("</root></mxGraphModel></diagram></mxfile>"))), "\n").alias("xml"))


def narration_prompt(diagram: Column, sql: Column, dialect: Column) -> Column:
    """A request to put a diagram's labels into plain words, with the diagram and the (clipped) source."""
    source = F.when(F.length(sql) > MOST_SQL, F.concat(F.substring(sql, 1, MOST_SQL), F.lit("\n-- […cut here…]"))).otherwise(sql)
    ask = (
        "Reword the labels of the flowchart below in plain language for business readers.\n"
        "It was derived from SQL text by static analysis; dynamic parts stay opaque, and nothing was executed.\n"
        "Change only the texts between the quotes of nodes, at most a dozen words each, decisions as questions. Keep ids, edges, "
        "arrows, shapes, edge labels and leading step numbers. Use no double quotes, bars or angle brackets in labels.\n"
        "Answer with the whole Mermaid text only.\n\nDIAGRAM:\n```mermaid\n"
    )
    return F.concat(F.lit(ask), diagram, F.lit("\n```\n\nSQL ("), _choose(dialect, DIALECT_NAMES, "SQL"), F.lit("):\n```sql\n"), F.coalesce(source, F.lit("")), F.lit("\n```"))
