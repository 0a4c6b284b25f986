"""Which error ends in which handler, as a relation between raisers and handlers.

Nothing here makes nodes: a region's raisers and catches go in, wires come out. ``POOL`` stands for the junction node in which
raisers meet before several catches; the caller makes it when ``pooled`` is set.
"""

from __future__ import annotations

from typing import NamedTuple

from ..functions.lexer import Tok
from . import transactions as tx

POOL = "*"


class Catch(NamedTuple):
    node: str
    label: str
    cond: list[Tok]


class Wire(NamedTuple):
    src: str
    dst: str
    label: str


class Wiring(NamedTuple):
    wires: list[Wire]
    reached: frozenset[str]  # catches that some error ends in
    handled: frozenset[str]  # raisers whose errors go no further
    pooled: bool


def unguided(entry: str, catches: list[Catch]) -> list[Wire]:
    """Without known raisers the region itself may fail anywhere."""
    return [Wire(entry, c.node, "error") for c in catches]


def undirected(entry: str, catches: list[Catch], raisers: list[str], fan_in: bool) -> Wiring:
    """Dialects whose handlers take every error of their region."""
    sure = certain(fan_in, raisers)
    pooled = sure and len(catches) > 1
    if pooled:
        wires = [Wire(POOL, c.node, "" if c.label == "CATCH" else c.label) for c in catches] + [Wire(x, POOL, "") for x in raisers]
    else:
        wires = [w for c in catches for w in (*unguided(entry, [] if sure else [c]), *(Wire(x, c.node, "") for x in raisers))]
    return Wiring(wires, frozenset(c.node for c in catches), frozenset(raisers), pooled)


def directed(entry: str, catches: list[Catch], raisers: list[str], known: dict[str, tx.PgError | None], fan_in: bool) -> Wiring:
    """PL/pgSQL: an error with a name or code ends in the first catch that takes it; any other may end in each."""
    named = {x: error for x in raisers if (error := known.get(x))}
    ends = {x: c.node for x, error in named.items() if (c := first(catches, error))}
    open_ended = [x for x in raisers if x not in named] if catches else []
    pooled = bool(open_ended) and len(catches) > 1
    wires = [Wire(x, node, "") for x, node in ends.items()]
    wires += [Wire(x, POOL if pooled else catches[0].node, "") for x in open_ended]
    wires += [Wire(POOL, c.node, c.label) for c in catches if pooled]
    if not certain(fan_in, raisers):
        wires += unguided(entry, catches)
    handled = set(ends)
    if any(tx.pg_catches_all(c.cond) for c in catches):
        handled.update(open_ended)
    nodes = {c.node for c in catches}
    return Wiring(wires, frozenset(w.dst for w in wires if w.dst in nodes), frozenset(handled), pooled)


def certain(fan_in: bool, raisers: list[str]) -> bool:
    """Whether every statement that may raise is among the raisers."""
    return fan_in and bool(raisers)


def first(catches: list[Catch], error: tx.PgError) -> Catch | None:
    return next((c for c in catches if tx.pg_catches(c.cond, error)), None)
