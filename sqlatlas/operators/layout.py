"""Layered layout of graphs: components, back edges, ranks, order in layers, coordinates, crossings and overlaps.

``lay_out`` handles one graph (an object's), ``layouts`` any number of them, one group per graph. ``components`` and ``ranks`` are the
DataFrame forms for large graphs; ``crossings`` and ``overlaps`` join within layers.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: gaps, centres, box sizes
GAPS = {"TD": (145, 220), "LR": (255, 115)}
CENTRE_X, CENTRE_Y, MARGIN = 520, 420, 45
LANE_OFFSET, LANE_STEP = 70, 44
BOXES = {"diamond": (180, 90), "hex": (180, 70), "round": (150, 58), "marker": (145, 52), "io": (190, 64)}
SWEEPS = 4


def box(shape: str, cls: str) -> tuple[int, int]:
    return BOXES.get("io" if cls == "src" and shape not in BOXES else shape, (180, 60))


def backbone(kind: str, style: str) -> bool:
    """Everything but solid data edges ranks the nodes."""
    return kind != "data" or style == "dotted"


def _back_edges(nodes: list[int], out: dict[int, list[int]]) -> set[tuple[int, int]]:
    """Edges to a node on the present path of a depth-first search in creation order."""
    state: dict[int, int] = {}
    back: set[tuple[int, int]] = set()
    for root in nodes:
        if state.get(root):
            continue
        state[root] = 1
        stack = [(root, iter(sorted(out[root])))]
        while stack:
            at, rest = stack[-1]
            to = next(rest, None)
            if to is None:
                state[at] = 2
                stack.pop()
            elif state.get(to) == 1:
                back.add((at, to))
            elif not state.get(to):
                state[to] = 1
                stack.append((to, iter(sorted(out[to]))))
    return back


def _component_of(n: int, pairs: list[tuple[int, int]]) -> list[list[int]]:
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    groups: dict[int, list[int]] = defaultdict(list)
    for i in range(n):
        groups[find(i)].append(i)
    return [groups[k] for k in sorted(groups)]


def _ranks(comp: list[int], out: dict[int, list[int]], back: set[tuple[int, int]]) -> dict[int, int]:
    degree = dict.fromkeys(comp, 0)
    for a in comp:
        for b in out[a]:
            degree[b] += (a, b) not in back
    rank = dict.fromkeys(comp, 0)
    ready = [i for i in comp if not degree[i]]
    for a in ready:
        for b in sorted(out[a]):
            if (a, b) not in back:
                rank[b] = max(rank[b], rank[a] + 1)
                degree[b] -= 1
                if not degree[b]:
                    ready.append(b)
    return rank


def lay_out(nodes: list[dict], edges: list[dict], direction: str = "TD") -> tuple[list[dict], dict]:
    """(rows: id, ord, rank, place, x, y, w, h; report) of one graph; creation order breaks every tie."""
    index = {n["id"]: i for i, n in enumerate(nodes)}
    wires = [(index[e["src"]], index[e["dst"]], e) for e in edges if e["src"] in index and e["dst"] in index]
    spine = [(a, b) for a, b, e in wires if backbone(e["kind"], e["style"])]
    out: dict[int, list[int]] = defaultdict(list)
    for a, b in spine:
        out[a].append(b)
    rank: dict[int, int] = {}
    back: set[tuple[int, int]] = set()
    band = 0
    for comp in _component_of(len(nodes), spine):
        local = _back_edges(comp, out)
        own = _ranks(comp, out, local)
        rank |= {i: band + r for i, r in own.items()}
        back |= local
        band += max(own.values()) + 1
    layers: list[list[int]] = [[] for _ in range(band)]
    for i in range(len(nodes)):
        layers[rank[i]].append(i)
    place = {i: k for layer in layers for k, i in enumerate(layer)}
    near: dict[int, list[int]] = defaultdict(list)
    for a, b, _ in wires:
        near[a].append(b)
        near[b].append(a)

    def sweep(g: int, to: int) -> None:
        def centre(i: int) -> float:
            own = [place[j] for j in near[i] if rank[j] == to]
            return sum(own) / len(own) if own else math.inf

        layers[g].sort(key=lambda i: (centre(i), place[i]))
        place.update({i: k for k, i in enumerate(layers[g])})

    wide = [g for g in range(band) if len(layers[g]) > 1]  # a layer of one has one order
    for _ in range(SWEEPS):
        before = [layers[g][:] for g in wide]
        for g in wide:
            if g:
                sweep(g, g - 1)
        for g in reversed(wide):
            if g < band - 1:
                sweep(g, g + 1)
        if all(layers[g] == old for g, old in zip(wide, before, strict=True)):  # a sweep that moves nothing moves nothing again
            break
    down = direction != "LR"
    gap, apart = GAPS["TD" if down else "LR"]
    rows = []
    for i, n in enumerate(nodes):
        w, h = box(n["shape"], n["cls"])
        across = place[i] * apart - (len(layers[rank[i]]) - 1) * apart / 2
        along = MARGIN + rank[i] * gap
        x, y = (CENTRE_X + across - w / 2, along) if down else (along, CENTRE_Y + across - h / 2)
        rows.append({"id": n["id"], "ord": i, "rank": rank[i], "place": place[i], "x": float(x), "y": float(y), "w": w, "h": h})
    crossing = _crossings([(a, b) for a, b, _ in wires], rank, place)
    report = {
        "layers": band, "crossings": crossing, "overlaps": _overlaps(rows), "back_edges": len(back),
        "backbone_edges": len(spine), "monotonic_edges": sum(rank[b] > rank[a] for a, b in spine), "path_edges": len(wires) - len(spine),
        "warning": "crossings detected; the layout is not planar" if crossing else None,
    }
    return rows, report


def _crossings(pairs: list[tuple[int, int]], rank: dict[int, int], place: dict[int, int]) -> int:
    by: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for a, b in pairs:
        a, b = (a, b) if rank[a] <= rank[b] else (b, a)
        by[rank[a], rank[b]].append((a, b))
    total = 0
    for (low, high), own in by.items():
        for i, (a, b) in enumerate(own):
            for c, d in own[i + 1 :]:
                if {a, b} & {c, d}:
                    continue
                flat = low == high  # both ends in one layer: the pair may be read either way
                total += ((place[a] < place[c]) != (place[b] < place[d])) if not flat else (place[a] < place[c]) != (place[b] < place[d])
    return total


def _overlaps(rows: list[dict]) -> int:
    total = 0
    order = sorted(rows, key=lambda r: r["x"])
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if b["x"] >= a["x"] + a["w"] - 0.5:
                break
            total += a["y"] < b["y"] + b["h"] - 0.5 and b["y"] < a["y"] + a["h"] - 0.5
    return total


def waypoints(rows: list[dict], edges: list[dict], direction: str = "TD") -> dict[int, list[tuple[int, int]]]:
    """Two points on a lane of its own for every solid data edge, by the edge's place."""
    at = {r["id"]: r for r in rows}
    down = direction != "LR"
    half = max((abs(r["x"] + r["w"] / 2 - CENTRE_X) if down else abs(r["y"] + r["h"] / 2 - CENTRE_Y) for r in rows), default=0)
    out: dict[int, list[tuple[int, int]]] = {}

    def near(v: float) -> int:
        return math.floor(v + 0.5)

    for k, e in enumerate(edges):
        if backbone(e["kind"], e["style"]) or e["src"] not in at or e["dst"] not in at:
            continue
        lane = near((CENTRE_X if down else CENTRE_Y) + half + LANE_OFFSET + len(out) * LANE_STEP)
        ends = [at[e["src"]], at[e["dst"]]]
        out[k] = [(lane, near(r["y"] + r["h"] / 2)) for r in ends] if down else [(near(r["x"] + r["w"] / 2), lane) for r in ends]
    return out


_NODE, _EDGE = ("id", "shape", "cls"), ("src", "dst", "kind", "style")


def graphs(batch: pa.RecordBatch) -> Iterator[tuple[list[dict], list[dict]]]:
    """Nodes and edges of every row, with what a layout reads of them: other fields cost more to convert than a layout to make."""

    def lists(name: str, fields: tuple[str, ...]) -> list[list[dict] | None]:
        column = batch.column(name)
        inner = pa.StructArray.from_arrays([column.values.field(f) for f in fields], fields)
        return pa.ListArray.from_arrays(column.offsets, inner).to_pylist()

    yield from zip(lists("nodes", _NODE), lists("edges", _EDGE), strict=True)


def layouts(rows: DataFrame, direction: str = "TD") -> DataFrame:
    """unit_id, id, ord, rank, place, x, y, w, h of the nodes of every row's graph (nodes, edges nested)."""

    names = ("rank", "place", "x", "y", "w", "h")
    kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32())

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                units, out = [], []
                for unit, (nodes, edges) in zip(part.column("unit_id").to_pylist(), graphs(part), strict=True):
                    own = lay_out(nodes, edges, direction)[0] if nodes else []
                    units += [unit] * len(own)
                    out += own
                told = [pa.array([r[k] for r in out], t) for k, t in zip(names, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array([r["id"] for r in out], pa.string()), pa.array([r["ord"] for r in out], pa.int32()), *told], ["unit_id", "id", "ord", *names])

    return rows.select("unit_id", "nodes", "edges").mapInArrow(run, "unit_id string, id string, ord int, rank int, place int, x double, y double, w int, h int")


def layout_reports(rows: DataFrame, direction: str = "TD") -> DataFrame:
    """unit_id and the report of every row's layout: layers, crossings, overlaps, back, backbone, monotonic and path edges, warning."""
    names = ("layers", "crossings", "overlaps", "back_edges", "backbone_edges", "monotonic_edges", "path_edges")

    def run(batches):
        for batch in batches:
            told = [lay_out(n, e, direction)[1] if n else {} for n, e in graphs(batch)]
            columns = [pa.array([int(t.get(k, 0)) for t in told], pa.int64()) for k in names]
            yield pa.RecordBatch.from_arrays([batch.column("unit_id"), *columns, pa.array([t.get("warning") for t in told], pa.string())], ["unit_id", *names, "warning"])

    return rows.select("unit_id", "nodes", "edges").mapInArrow(run, f"unit_id string, {', '.join(f'{k} long' for k in names)}, warning string")


# --- large graphs as DataFrames --------------------------------------------------------------------


def components(nodes: DataFrame, edges: DataFrame, most: int = 200) -> DataFrame:
    """id, component (the smallest id of it): labels spread to neighbours and jump to their own label, until nothing changes."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct()
    labels = nodes.select("id", F.col("id").alias("component")).checkpoint()
    for _ in range(most):
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("c"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", "component", F.least("component", F.coalesce("c", "component")).alias("now"))
        far = labels.select(F.col("id").alias("now"), F.col("component").alias("far"))
        step = step.join(far, "now").select("id", F.col("component").alias("old"), F.least("now", "far").alias("component")).checkpoint()
        labels = step.select("id", "component")
        if step.filter("old <> component").isEmpty():
            return labels
    raise ValueError(f"the components did not settle in {most} rounds")


def ranks(nodes: DataFrame, edges: DataFrame, most: int = 1000) -> DataFrame:
    """id, rank: the longest path into each node of an acyclic graph, level by level."""
    rank = nodes.select("id", F.lit(0).alias("rank")).checkpoint()
    for _ in range(most):
        best = edges.join(rank.withColumnRenamed("id", "src"), "src").groupBy("dst").agg((F.max("rank") + 1).alias("r"))
        step = rank.join(best.withColumnRenamed("dst", "id"), "id", "left").select("id", F.col("rank").alias("old"), F.greatest("rank", F.coalesce("r", F.lit(0))).alias("rank")).checkpoint()
        rank = step.select("id", "rank")
        if step.filter("old <> rank").isEmpty():
            return rank
    raise ValueError("the graph has a cycle or longer paths than allowed")


def inversions(x: np.ndarray) -> int:
    """Pairs of an array in falling order, by merging blocks of 1, 2, 4, ... elements."""
    x = np.unique(x, return_inverse=True)[1].astype(np.int64)
    n, total, width = len(x), 0, 1
    while width < n:
        block = np.arange(n) // (2 * width)
        left = np.arange(n) % (2 * width) < width
        keys = block * (n + 1) + x  # both halves of each block are sorted
        low, high = keys[left], keys[~left]
        ends = np.searchsorted(low, (block[~left] + 1) * (n + 1))
        total += int((ends - np.searchsorted(low, high, "right")).sum())
        x = np.sort(keys) - block * (n + 1)
        width *= 2
    return total


def crossings(wires: DataFrame) -> DataFrame:
    """One row: n, the pairs of wires (layer_lo, layer_hi, lo, hi) of the same two layers in opposite orders.

    Wires with a common end have a common place there and do not cross. Each pair of layers is sorted and its inversions are counted.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [inversions(part.sort_values(["lo", "hi"])["hi"].to_numpy())]})

    by = wires.select("layer_lo", "layer_hi", "lo", "hi").groupBy("layer_lo", "layer_hi").applyInPandas(run, "n long")
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def overlaps(boxes: DataFrame, cell: int = 256) -> DataFrame:
    """One row: n, the pairs of boxes (id, x, y, w, h) that intersect; boxes meet in the grid cells that they cover."""

    def cells(lo: str, size: str):
        return F.sequence(F.floor(F.col(lo) / cell).cast("long"), F.floor((F.col(lo) + F.col(size)) / cell).cast("long"))

    grid = boxes.withColumn("cx", F.explode(cells("x", "w"))).withColumn("cy", F.explode(cells("y", "h")))
    a, b = grid.alias("a"), grid.alias("b")
    meet = (F.col("a.x") < F.col("b.x") + F.col("b.w") - 0.5) & (F.col("b.x") < F.col("a.x") + F.col("a.w") - 0.5) & (F.col("a.y") < F.col("b.y") + F.col("b.h") - 0.5) & (F.col("b.y") < F.col("a.y") + F.col("a.h") - 0.5)
    pairs = a.join(b, (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.id") < F.col("b.id")) & meet)
    return pairs.select(F.col("a.id").alias("p"), F.col("b.id").alias("q")).distinct().agg(F.count("*").alias("n"))
