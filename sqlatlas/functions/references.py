"""What a statement refers to: CTEs, sources, counters, reads, writes, calls. Per statement, over its tokens.

``source_frame`` is the window form over a token table.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lexer import Tok
from .vocab import CALL_HEADS, SOURCE_LIST_ENDS, SOURCE_OPENERS, TABULAR_FUNCTIONS
from .wording import dotted, first_of, word_at


class Cte(NamedTuple):
    name: str
    body: Sequence[Tok]


class Ref(NamedTuple):
    name: str
    start: int
    end: int
    resolution: str
    apply: bool


@dataclass
class Sources:
    refs: list[Ref] = field(default_factory=list)
    joins: int = 0
    unions: int = 0
    subs: int = 0
    filtered: bool = False
    agg: bool = False

    @property
    def names(self) -> list[str]:
        return [r.name for r in self.refs]


def _close(toks: Sequence[Tok], i: int) -> int:
    """One past the parenthesis that closes the one at i, or the end."""
    depth = 0
    for k in range(i, len(toks)):
        depth += {"(": 1, ")": -1}.get(toks[k].v, 0)
        if depth == 0 and toks[k].v == ")":
            return k + 1
    return len(toks)


def ctes(toks: Sequence[Tok]) -> tuple[list[Cte], int]:
    """The CTEs of a statement that begins with WITH, and where its final query starts."""
    out: list[Cte] = []
    if word_at(toks, 0) != "WITH":
        return out, 0
    i = 2 if word_at(toks, 1) == "RECURSIVE" else 1
    while i < len(toks) and toks[i].kind == "word":
        name, i = toks[i].v, i + 1
        if i < len(toks) and toks[i].v == "(":
            i = _close(toks, i)
        if word_at(toks, i) != "AS":
            break
        i += 1
        while word_at(toks, i) in ("MATERIALIZED", "NOT"):
            i += 1
        if i >= len(toks) or toks[i].v != "(":
            break
        start, i = i, _close(toks, i)
        out.append(Cte(name, toks[start + 1 : i - 1]))
        if i < len(toks) and toks[i].v == ",":
            i += 1
            continue
        break
    return out, i


def _source(toks: Sequence[Tok], i: int, apply: bool) -> Ref | None:
    if i >= len(toks) or toks[i].kind != "word" or toks[i].u in ("LATERAL", "VALUES"):
        return None
    t = toks[i]
    if t.u in TABULAR_FUNCTIONS:
        return Ref(t.v, t.pos, t.end, "opaque", False)
    k = i + 1
    while k + 1 < len(toks) and toks[k].v == "." and toks[k + 1].kind == "word":
        k += 2
    name = dotted(toks, i)
    return Ref(name, t.pos, toks[k - 1].end, "heuristic" if apply or name.count(".") >= 2 else "exact", apply)


def sources(toks: Sequence[Tok]) -> Sources:
    """One list of sources is open at a time, at the depth of its opener; an inner list replaces it for good."""
    out, depth, list_depth = Sources(), 0, None
    for i, t in enumerate(toks):
        ref = None
        if t.v == "(":
            depth += 1
            out.subs += word_at(toks, i + 1) == "SELECT"
        elif t.v == ")":
            depth -= 1
            if list_depth is not None and depth < list_depth:
                list_depth = None
        elif t.v == ",":
            ref = _source(toks, i + 1, False) if depth == list_depth else None
        elif t.kind == "word":
            out.joins += t.u == "JOIN"
            out.unions += t.u == "UNION"
            out.filtered |= t.u == "WHERE" and depth == 0
            out.agg |= t.u in ("GROUP", "DISTINCT") and depth == 0
            if t.u in SOURCE_OPENERS:
                list_depth = depth
                ref = _source(toks, i + 1, t.u == "APPLY")
            elif depth == list_depth and t.u in SOURCE_LIST_ENDS:
                list_depth = None
        if ref:
            out.refs.append(ref)
    return out


def behind_cursor(toks: Sequence[Tok]) -> Sequence[Tok]:
    """The query after CURSOR … FOR, or all tokens."""
    cursor = first_of(toks, "CURSOR", 0)
    at = first_of(toks, "FOR", cursor + 1) if cursor >= 0 else -1
    return toks[at + 1 :] if at >= 0 else toks


def distinct(names: Iterable[str]) -> list[str]:
    """Case-insensitive, first spelling, first order."""
    out: dict[str, str] = {}
    for n in names:
        if n:
            out.setdefault(n.upper(), n)
    return list(out.values())


@dataclass
class Facts:
    reads: list[str]
    writes: list[str]
    calls: list[str]
    result_set: bool
    dynamic: bool


def _skip(toks: Sequence[Tok], i: int, words: tuple[str, ...], most: int = 99) -> int:
    while most and word_at(toks, i) in words:
        i, most = i + 1, most - 1
    return i


def _written(toks: Sequence[Tok]) -> int:
    """Where the name of the written object starts, or -1."""
    head = word_at(toks, 0)
    if head in ("INSERT", "REPLACE"):
        return _skip(toks, 1, ("INTO", "OR", "IGNORE", "REPLACE"))
    if head == "UPDATE":
        if word_at(toks, 1) != "TOP":
            return 1
        if len(toks) > 2 and toks[2].v == "(":
            return next((k for k in range(2, len(toks)) if toks[k].v == ")"), len(toks)) + 1
        return 3
    if head in ("DELETE", "MERGE", "TRUNCATE"):
        return _skip(toks, 1, ({"DELETE": "FROM", "MERGE": "INTO", "TRUNCATE": "TABLE"}[head],), 1)
    if head == "CREATE" and word_at(toks, 1) == "TABLE":
        return 2
    if head == "SELECT":
        depth = 0
        for k in range(1, len(toks) - 1):
            if toks[k].v in "()":
                depth += 1 if toks[k].v == "(" else -1
            elif depth == 0 and toks[k].u == "INTO" and not toks[k + 1].v.startswith("@"):
                return k + 1
    return -1


def facts(toks: Sequence[Tok], dynamic: bool = False) -> Facts:
    named, start = ctes(toks)
    own = {c.name.upper() for c in named}
    reads = [n for n in sources(toks).names if n.upper() not in own]
    work = toks[start:] if named else toks
    head, at = word_at(work, 0), _written(work)
    writes = [dotted(work, at)] if 0 < at < len(work) else []
    calls: list[str] = []
    if head in CALL_HEADS and not dynamic:
        i = 3 if len(work) > 2 and work[1].v.startswith("@") and work[2].v == "=" else 1
        calls = [dotted(work, i)]
    return Facts(distinct(reads), distinct(writes), distinct(calls), head == "SELECT" and all(t.u != "INTO" for t in work), dynamic)


def source_frame(toks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ord, name, resolution, is_apply: the sources of every statement of a token table, by windows alone.

    Openers cut a statement into segments; the list of a segment has its opener's depth and ends at the first closing word or
    parenthesis. Sources are the openers and the commas at that depth before the end.
    """
    own = Window.partitionBy(*keys).orderBy("ord")
    upto, before = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    opener = (F.col("kind") == "word") & F.col("u").isin(*SOURCE_OPENERS)
    d = toks.withColumns({"opener": opener, "depth": F.sum(F.when(F.col("v") == "(", 1).when(F.col("v") == ")", -1).otherwise(0)).over(upto)})
    d = d.withColumn("segment", F.sum(F.col("opener").cast("int")).over(upto))
    part = Window.partitionBy(*keys, "segment").orderBy("ord")
    d = d.withColumn("list_depth", F.first("depth").over(part.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ((F.col("v") == ")") & (F.col("depth") < F.col("list_depth"))) | ((F.col("kind") == "word") & ~F.col("opener") & F.col("u").isin(*SOURCE_LIST_ENDS) & (F.col("depth") == F.col("list_depth")))
    d = d.withColumn("ended", F.coalesce(F.max(ends.cast("int")).over(part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1)
    # a dotted name is a run of tokens in which dots and others take turns
    ahead = own.rowsBetween(0, 12)
    d = d.withColumns({"run": F.collect_list("v").over(ahead), "kinds": F.collect_list("kind").over(own.rowsBetween(1, 1)), "upper": F.lead("u").over(own)})
    source = (F.col("segment") > 0) & (F.col("opener") | ((F.col("v") == ",") & ~F.col("ended") & (F.col("depth") == F.col("list_depth"))))
    d = d.filter(source & (F.get("kinds", F.lit(0)) == "word") & ~F.col("upper").isin("LATERAL", "VALUES"))
    tabular = F.col("upper").isin(*TABULAR_FUNCTIONS)
    longest = F.filter(F.sequence(F.lit(1), F.lit(6)), lambda k: F.forall(F.sequence(F.lit(1), F.lit(6)), lambda j: (j >= k) | (F.get("run", 2 * j) == ".")))
    parts = F.array_max(F.filter(longest, lambda k: F.get("run", 2 * k - 1).isNotNull()))
    name = F.when(tabular, F.get("run", F.lit(1))).otherwise(F.array_join(F.slice("run", F.lit(2), 2 * parts - 1), ""))
    d = d.withColumn("name", name).withColumn("is_apply", F.col("u") == "APPLY")
    size = F.length("name") - F.length(F.replace("name", F.lit("."), F.lit("")))
    resolution = F.when(tabular, "opaque").when(F.col("is_apply") | (size >= 2), "heuristic").otherwise("exact")
    return d.select(*keys, "ord", "name", resolution.alias("resolution"), (F.col("is_apply") & ~tabular).alias("is_apply"))
