"""Query structure of statements and objects: CTEs, final queries and sources as nodes, dependencies as edges."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from ..functions.lexer import Tok
from ..functions.references import Sources, behind_cursor, ctes, distinct, sources
from ..functions.vocab import QUERY_HEADS
from ..functions.wording import span, summary, word_at
from .flow import GEdge, GNode, Graph, Options
from .parser import Parsed, walk

DEEPEST = 60
#: name -> (resolution, canonical name); the catalogue, if there is one
Resolver = Callable[[str], tuple[str, str | None]]


def describe(s: Sources) -> str:
    def many(n: int, one: str, more: str) -> list[str]:
        return [f"{n} {one if n == 1 else more}"] if n else []

    bits = many(s.joins, "join", "joins") + many(s.unions, "union", "unions") + many(s.subs, "subquery", "subqueries")
    return " · ".join(bits + ["filtered"] * s.filtered + ["grouped"] * s.agg)


def source_node(name: str, resolve: Resolver | None) -> GNode:
    how, canonical = resolve(name) if resolve else ("external", None)
    sure = how == "verified"
    return GNode("", "io", canonical if sure and canonical else name, "src", provenance="external" if sure else "synthetic", reason=None if sure else "external source object", resolution=how if how != "external" else None, resolved=canonical if sure else None)


def longest_chain(edges: Sequence[GEdge], final: str) -> int:
    """Edges on the longest path into final."""
    into: dict[str, list[str]] = {}
    for e in edges:
        into.setdefault(e.dst, []).append(e.src)
    memo: dict[str, int] = {}

    def depth(node: str, guard: int) -> int:
        if node not in memo:
            if guard > DEEPEST:
                return 0
            memo[node] = max((depth(x, guard + 1) + 1 for x in into.get(node, ())), default=0)
        return memo[node]

    return depth(final, 0)


def statement_graph(toks: Sequence[Tok], title: str, options: Options, resolve: Resolver | None = None) -> Graph:
    named, start = ctes(toks)
    g = Graph()

    def add(shape: str, cls: str, lines: list[str], where) -> str:
        lines = [x.strip() for x in lines if x.strip()]
        g.nodes.append(GNode(f"q{len(g.nodes) + 1}", shape, "\n".join(lines), cls, where, lines, "source" if where else "synthetic"))
        return g.nodes[-1].id

    infos = [sources(c.body) for c in named]
    own: dict[str, str] = {}
    recursive = 0
    for c, s in zip(named, infos, strict=True):
        again = c.name.upper() in (x.upper() for x in s.names)
        recursive += again
        own[c.name.upper()] = add("rect", "cte", [c.name, describe(s), "recursive CTE" if again else ""], span(c.body))
    last = sources(toks[start:])
    final = add("round", "final", [title or "Final SELECT", describe(last)], span(toks[start:]))
    found: dict[str, str] = {}
    tables: set[str] = set()

    ranked: list[tuple[str, str, str]] = []
    for to, s in [*((own[c.name.upper()], s) for c, s in zip(named, infos, strict=True)), (final, last)]:
        ranked += [(to, n.upper(), n) for n in distinct(s.names)]
    for to, key, name in ranked:
        if key in own:
            src = own[key]
        else:
            tables.add(key)
            if not options.sources:
                continue
            if key not in found:
                node = source_node(name, resolve)
                node.id = f"q{len(g.nodes) + 1}"
                g.nodes.append(node)
                found[key] = node.id
            src = found[key]
        if src != to:
            g.edges.append(GEdge(src, to, kind="dependency"))
    every = [*infos, last]
    g.stats = {"ctes": len(named), "tables": len(tables), "joins": sum(s.joins for s in every), "unions": sum(s.unions for s in every), "subs": sum(s.subs for s in every), "recursive": recursive}
    g.stats["depth"] = longest_chain(g.edges, final)
    g.stats["parts"] = sum(g.stats[k] for k in ("ctes", "joins", "unions", "subs"))
    g.empty = not named and not last.refs
    return g


def query_statements(parsed: Parsed) -> list[Sequence[Tok]]:
    """Token runs of an object that hold a query, control flow aside."""
    out: list[Sequence[Tok]] = []

    def cursor(toks: Sequence[Tok], otherwise: Sequence[Tok] | None) -> None:
        query = behind_cursor(toks)
        if query and query[0].u in QUERY_HEADS:
            out.append(query)
        elif otherwise is not None:
            out.append(otherwise)

    for n, _ in walk(parsed.tree):
        if n.toks and n.kind != "unknown":
            toks = parsed.text(n.toks)
            named, start = ctes(toks)
            head = word_at(toks, start)
            if head == "DECLARE" and any(t.u == "CURSOR" for t in toks):
                cursor(toks, toks)
            elif named or head in QUERY_HEADS:
                out.append(toks)
        elif n.kind == "for" and n.cond and any(t.u == "CURSOR" for t in parsed.text(n.cond)):
            cursor(parsed.text(n.cond), None)
    return out


def object_graph(parsed: Parsed, options: Options, resolve: Resolver | None = None) -> Graph:
    g = Graph(stats=dict.fromkeys(("ctes", "tables", "joins", "unions", "subs", "depth", "parts", "recursive"), 0))
    shared: dict[str, str] = {}
    statements = query_statements(parsed)
    for toks in statements:
        child = statement_graph(toks, summary(toks[ctes(toks)[1] :], 64), options, resolve)
        new: dict[str, str] = {}
        for n in child.nodes:
            key = n.text.upper() if n.cls == "src" else None
            if key in shared:
                new[n.id] = shared[key]
                continue
            old, n.id = n.id, f"oq{len(g.nodes) + 1}"
            new[old] = n.id
            if key:
                shared[key] = n.id
            g.nodes.append(n)
        g.edges += [GEdge(new[e.src], new[e.dst], e.label, e.style, e.kind) for e in child.edges if new[e.src] != new[e.dst]]
        for k in ("ctes", "joins", "unions", "subs", "recursive"):
            g.stats[k] += child.stats[k]
        g.stats["depth"] = max(g.stats["depth"], child.stats["depth"])
    g.stats["tables"] = len(shared)
    g.stats["parts"] = sum(g.stats[k] for k in ("ctes", "joins", "unions", "subs")) + len(statements)
    if not g.nodes:
        g.nodes.append(GNode("oq1", "round", "No query-bearing statements found", "final", provenance="synthetic", reason="no query-bearing statements in this object"))
    g.empty = not statements
    return g

