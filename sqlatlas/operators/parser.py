"""Block-structured parsing of one object: recursive descent into a tree of nodes.

Nodes refer to the object's body tokens by ranges (lo, hi), so the tree flattens into rows (``flatten``) and every token has
an owner. Dispatch is by first word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..functions.lexer import Finding, Tok, lex
from ..functions.vocab import (
    BLOCK_STOPS,
    CONTINUES,
    CONTINUING_OPS,
    HARD,
    NAME_STOPS,
    OBJECT_KINDS,
    OBJECT_MODIFIERS,
    OPENERS,
    RAISE_LEVELS,
    SOFT,
)

Range = tuple[int, int]
MOST_STEPS = 40_000
LOOPS = ("while", "for", "loop", "repeat")


@dataclass
class Node:
    """kind; toks of a statement; cond (condition, head or selector); parts: (slot, condition range or None, nodes)."""

    kind: str
    toks: Range | None = None
    cond: Range | None = None
    parts: list[tuple[str, Range | None, list[Node]]] = field(default_factory=list)
    label: str | None = None
    target: str | None = None
    word: str | None = None
    span: Range | None = None
    when: Range | None = None
    atomic: bool = False

    def part(self, slot: str) -> list[Node]:
        return next((nodes for s, _, nodes in self.parts if s == slot), [])

    def has(self, slot: str) -> bool:
        return any(s == slot for s, _, _ in self.parts)


def walk(nodes: list[Node], depth: int = 0) -> Iterator[tuple[Node, int]]:
    for n in nodes:
        yield n, depth
        for _, _, inner in n.parts:
            yield from walk(inner, depth + 1)


@dataclass
class Header:
    name: str = ""
    params: str = ""
    kind: str = ""
    index: int = 0
    gate: list[Tok] | None = None
    inner: str | None = None
    offset: int = 0


_TAG = re.compile(r"\$[A-Za-z_]*\$")


def _u(toks: list[Tok], i: int) -> str:
    return toks[i].u if 0 <= i < len(toks) else ""


def _dollar(t: Tok, **known) -> Header:
    tag = _TAG.match(t.v)
    body = t.v[tag.end() :]
    tail = re.search(r"\$[A-Za-z_]*\$$", body)
    return Header(index=-1, inner=body[: tail.start()] if tail else body, offset=t.pos + tag.end(), **known)


def _parameters(toks: list[Tok], start: int) -> str:
    names: list[str] = []
    depth = 0
    for k in range(start, min(len(toks), start + 120)):
        t = toks[k]
        if t.v == "(":
            depth += 1
        elif t.v == ")":
            depth -= 1
            if depth <= 0 and names:
                break
        elif t.u in ("AS", "BEGIN", "RETURNS") and depth <= 0:
            break
        elif depth == 1 or t.v.startswith("@"):
            before = toks[k - 1] if k else None
            modes = ("IN", "OUT", "INOUT", "VARIADIC")
            named = t.v.startswith("@") or (t.kind == "word" and (before is None or before.v in "(," or before.u in modes))
            if named and len(names) < 10 and t.u not in modes:
                names.append(t.v)
    return ", ".join(names)


def header(toks: list[Tok], dialect: str) -> Header:
    """The object's header and where its body starts."""
    i = 0
    while _u(toks, i) in ("SET", "USE", "GO", "PRAGMA"):
        while i < len(toks) and toks[i].v != ";" and toks[i].u != "GO":
            i += 1
        i += i < len(toks)
    start = i
    if dialect == "plpgsql" and _u(toks, i) == "DO":
        body = next((t for t in toks[i + 1 :] if t.kind == "dollar"), None)
        if body:
            return _dollar(body, kind="DO")
    none = Header(index=start)
    if _u(toks, i) not in ("CREATE", "ALTER", "REPLACE"):
        return none
    i += 1
    while _u(toks, i) in OBJECT_MODIFIERS or _u(toks, i) in ("OR", "ALTER", "REPLACE"):
        i += 1
    if _u(toks, i) not in OBJECT_KINDS:
        return none
    kind, first = toks[i].u, i + 1
    i = first
    while i < len(toks) and toks[i].v != "(" and toks[i].u not in NAME_STOPS and not toks[i].v.startswith("@"):
        i += 1
    known = {"name": "".join(t.v for t in toks[first:i]), "params": _parameters(toks, i), "kind": kind}
    if dialect == "plpgsql" and (body := next((t for t in toks[i:] if t.kind == "dollar"), None)):
        return _dollar(body, **known)
    flat, depth = [], 0  # places outside parentheses
    for k in range(i, len(toks)):
        if toks[k].v in "()":
            depth += 1 if toks[k].v == "(" else -1
        elif depth == 0:
            flat.append(k)
    begin = next((k for k in flat if toks[k].u == "BEGIN"), None)
    if (dialect == "sqlite" or kind == "TRIGGER") and begin is not None:
        when = next((k for k in flat if k < begin and toks[k].u == "WHEN"), None)
        return Header(index=begin, gate=None if when is None else toks[when + 1 : begin], **known)
    if dialect == "db2" and begin is not None:
        return Header(index=begin, **known)
    for k in flat:
        if toks[k].kind != "word":
            continue
        if toks[k].u == "AS":
            follows = toks[k + 1] if k + 1 < len(toks) else None
            clause = _u(toks, k - 1) == "EXECUTE" or (follows and (follows.u in ("OWNER", "SELF", "CALLER") or follows.kind == "str"))
            if not clause:
                return Header(index=k + 1, **known)
        elif toks[k].u == "BEGIN" and toks[k].nl:
            return Header(index=k, **known)
    return Header(index=start, **known)


def severity(toks: list[Tok]) -> int | None:
    """The static severity of a RAISERROR: the number after the first comma of its own parentheses."""
    depth = 0
    if _u(toks, 0) == "RAISERROR":
        for i, t in enumerate(toks[1:-1], 1):
            if t.v in "()":
                depth += 1 if t.v == "(" else -1
            elif t.v == "," and depth == 1:
                x = toks[i + 1]
                return int(x.v) if x.kind == "num" and x.v.isascii() and x.v.isdigit() else None
    return None


class Parser:
    def __init__(self, toks: list[Tok], dialect: str):
        self.t, self.i, self.dialect, self.hard = toks, 0, dialect, HARD[dialect]
        self.findings: list[Finding] = []
        self.rules = {
            "BEGIN": self._begin, "IF": self._if, "CASE": self._case, "WHILE": self._while, "RETURN": self._return,
            "EXEC": self._dynamic, "EXECUTE": self._dynamic, "GOTO": self._goto,
            **dict.fromkeys(("BREAK", "LEAVE", "EXIT", "CONTINUE", "ITERATE"), self._control),
        }
        if dialect == "tsql":
            self.rules |= {"GO": self._go, "THROW": lambda: Node("throw", self.read()), "RAISERROR": self._raiserror}
        else:
            self.rules |= {"LOOP": self._loop, "REPEAT": self._repeat, "FOR": self._for, "FOREACH": self._for}
        if dialect == "db2":
            self.rules |= {"DECLARE": self._handler, **dict.fromkeys(("SIGNAL", "RESIGNAL"), lambda: Node("throw", self.read()))}
        if dialect == "plpgsql":
            self.rules["RAISE"] = self._raise

    # cursor
    def tok(self, k: int = 0) -> Tok | None:
        return self.t[self.i + k] if self.i + k < len(self.t) else None

    def u(self, k: int = 0) -> str:
        t = self.tok(k)
        return t.u if t and t.kind == "word" else ""

    def v(self, k: int = 0) -> str:
        t = self.tok(k)
        return t.v if t else ""

    def eat(self, *words: str) -> bool:
        if self.u() in words and self.u():
            self.i += 1
            return True
        return False

    def semis(self) -> None:
        while self.v() == ";":
            self.i += 1

    # token runs
    def _splits(self, t: Tok, before: Tok | None, first: str) -> bool:
        """Whether a word that may start a statement does start one here."""
        if before is None or before.u in CONTINUES or before.v in CONTINUING_OPS or t.u == "CASE":
            return False
        dml = ("UPDATE", "DELETE", "MERGE", "INSERT")
        return not (
            (t.u == "SELECT" and first in ("INSERT", "WITH", "CREATE", "DECLARE", "MERGE", "RETURN"))
            or (t.u == "RAISE" and before.u == "SELECT")
            or (t.u in ("SET", "OUTPUT", "VALUES") and first in dml)
            or (t.u in ("UPDATE", "DELETE", "INSERT") and first == "MERGE")
            or (t.u == "EXECUTE" and before.u == "AS")
            or (t.u == "WITH" and before.v == ")")
        )

    def read(self, mode: str = "stmt") -> Range:
        """A run of tokens: a statement, a condition, a loop head or a selector."""
        lo, depth, cases = self.i, 0, 0
        first = self.tok().u if self.tok() else ""
        stops = {
            "head": lambda t, b: t.u in ("DO", "LOOP"),
            "case": lambda t, b: t.u in ("WHEN", "THEN", "ELSE"),
            "cond": lambda t, b: t.u in OPENERS or t.u in self.hard or t.u in SOFT,
            "stmt": lambda t, b: t.u in self.hard or (t.u in SOFT and self._splits(t, b, first)),
        }[mode]
        while (t := self.tok()) is not None:
            if t.v == ";" and depth == 0 and cases == 0:
                hi = self.i
                self.i += mode != "cond"
                return lo, hi
            if t.kind == "word" and depth == 0 and first != "MERGE":
                started = self.i > lo
                if t.u == "CASE" and started:
                    cases += 1
                elif t.u == "END":
                    if not cases:
                        break
                    cases -= 1
                elif not cases and started and stops(t, self.t[self.i - 1]):
                    break
            depth += {"(": 1, ")": -1}.get(t.v, 0)
            self.i += 1
        return lo, self.i

    def body(self, r: Range) -> list[Tok]:
        return self.t[r[0] : r[1]]

    # blocks
    def block(self, *more: str) -> list[Node]:
        out: list[Node] = []
        steps = 0
        while self.i < len(self.t):
            if steps >= MOST_STEPS:
                t = self.tok()
                self.findings.append(Finding("error", "parser_guard_exhausted", "The parser gave up before the end of the input.", t.pos, t.end))
                break
            steps += 1
            if self.v() == ";":
                self.i += 1
                continue
            if self.u() in BLOCK_STOPS or (self.u() and self.u() in more):
                break
            at = self.i
            node = self.statement()
            if node:
                out.append(node)
            self.i += self.i == at
        return out

    def end(self, kind: str | None) -> None:
        if self.u() != "END":
            t = self.tok() or (self.t[-1] if self.t else None)
            what = "END" + (f" {kind}" if kind else "")
            self.findings.append(Finding("error", "missing_end", f"{what} is missing here.", t.pos if t else None, t.end if t else None))
            return
        self.i += 1
        if kind and self.u() == kind:
            self.i += 1
        elif self.dialect != "tsql" and self.u() in ("IF", "WHILE", "LOOP", "FOR", "REPEAT", "CASE") and not self.tok().nl:
            self.i += 1
        t = self.tok()
        if t and t.kind == "word" and not t.nl and t.u not in SOFT and t.u not in self.hard and not t.v.startswith("@") and self.v(1) == ";":
            self.i += 1  # the label of the block
        self.semis()

    def statement(self) -> Node | None:
        t = self.tok()
        if t is None:
            return None
        if t.v == "<<":
            label = self.v(1)
            self.i += 3
            return self._labelled(label)
        if t.kind == "word":
            if self.v(1) == ":" and t.u not in self.hard and t.u not in SOFT and not t.v.startswith("@"):
                if self.u(2) in ("LOOP", "WHILE", "FOR", "REPEAT", "BEGIN"):
                    self.i += 2
                    return self._labelled(t.v)
                lo = self.i
                self.i += 2
                return Node("label", (lo, lo + 2), label=t.v, span=(t.pos, self.t[lo + 1].end))
            rule = self.rules.get(t.u)
            node = rule() if rule else None
            if node:
                return node
        return self._plain()

    def _labelled(self, label: str) -> Node | None:
        node = self.statement()
        if node:
            node.label = label
        return node

    def _plain(self) -> Node | None:
        r = self.read()
        if r[0] == r[1]:
            self.i += self.i == r[0]
            return None
        return (self._sqlite_raise(r) if self.dialect == "sqlite" else None) or Node("stmt", r)

    def _one(self) -> list[Node]:
        node = self.statement()
        return [node] if node else []

    def _block_node(self, *more: str) -> Node:
        return Node("block", parts=[("body", None, self.block(*more))])

    def _go(self) -> Node:
        self.i += 1
        return Node("go")

    def _begin(self) -> Node | None:
        word, nothing = self.u(1), self.tok(1) is None or self.v(1) == ";"
        if self.dialect == "tsql" and word == "TRY":
            self.i += 2
            tried = self.block()
            self.end("TRY")
            caught: list[Node] = []
            if self.u() == "BEGIN" and self.u(1) == "CATCH":
                self.i += 2
                caught = self.block()
                self.end("CATCH")
            return Node("try", parts=[("body", None, tried), ("handler", None, caught)])
        if nothing or (self.tok(1).u in ("TRANSACTION", "TRAN", "DISTRIBUTED", "WORK", "ISOLATION")):
            return Node("stmt", self.read())
        self.i += 1
        atomic = self.eat("ATOMIC")
        if not atomic:
            self.eat("NOT")
            self.eat("ATOMIC")
        inner = self.block()
        handlers: list[tuple[str, Range | None, list[Node]]] = []
        if self.eat("EXCEPTION"):
            while self.eat("WHEN"):
                cond = self.read("cond")
                self.eat("THEN")
                handlers.append(("handler", cond, self.block()))
        self.end(None)
        if handlers:
            return Node("try", parts=[("body", None, inner), *handlers])
        return Node("block", parts=[("body", None, inner)], atomic=atomic)

    def _if(self) -> Node:
        self.i += 1
        cond = self.read("cond")
        if not self.eat("THEN"):
            node = Node("if", cond=cond, parts=[("then", None, self._one())])
            self.semis()
            if self.eat("ELSE"):
                node.parts.append(("else", None, self._one()))
            return node
        top = last = Node("if", cond=cond, parts=[("then", None, [self._block_node()])])
        while self.eat("ELSEIF", "ELSIF"):
            cond = self.read("cond")
            self.eat("THEN")
            nested = Node("if", cond=cond, parts=[("then", None, [self._block_node()])])
            last.parts.append(("else", None, [nested]))
            last = nested
        if self.eat("ELSE"):
            last.parts.append(("else", None, [self._block_node()]))
        self.end("IF")
        return top

    def _case(self) -> Node:
        self.i += 1
        node = Node("case", cond=self.read("case"))
        while self.eat("WHEN"):
            cond = self.read("cond")
            self.eat("THEN")
            node.parts.append(("branch", cond, self.block()))
        if self.eat("ELSE"):
            node.parts.append(("else", None, self.block()))
        self.end("CASE")
        return node

    def _while(self) -> Node:
        self.i += 1
        cond = self.read("cond")
        if self.eat("DO", "LOOP"):
            node = Node("while", cond=cond, parts=[("body", None, [self._block_node()])])
            self.end(None)
            return node
        return Node("while", cond=cond, parts=[("body", None, self._one())])

    def _loop(self) -> Node:
        self.i += 1
        node = Node("loop", parts=[("body", None, [self._block_node()])])
        self.end("LOOP")
        return node

    def _repeat(self) -> Node:
        self.i += 1
        inner = self._block_node("UNTIL")
        self.eat("UNTIL")
        node = Node("repeat", cond=self.read("cond"), parts=[("body", None, [inner])])
        self.end("REPEAT")
        return node

    def _for(self) -> Node:
        self.i += 1
        head = self.read("head")
        if not self.eat("DO", "LOOP"):
            return Node("stmt", head)
        node = Node("for", cond=head, parts=[("body", None, [self._block_node()])])
        self.end(None)
        return node

    def _handler(self) -> Node | None:
        kind = self.v(1).upper()
        if not (kind in ("CONTINUE", "EXIT", "UNDO") and self.u(2) == "HANDLER"):
            return None
        self.i += 3
        self.eat("FOR")
        cond = self.read("cond")
        return Node("handler", cond=cond, word=kind, parts=[("body", None, self._one())])

    def _return(self) -> Node:
        inside = self.dialect == "plpgsql" and self.u(1) in ("NEXT", "QUERY")
        return Node("stmt" if inside else "return", self.read())

    def _raiserror(self) -> Node:
        r = self.read()
        level = severity(self.body(r))
        return Node("throw" if level is not None and level > 10 else "stmt", r)

    def _raise(self) -> Node:
        lo, level = self.i, self.u(1)
        self.i += 2 if level in RAISE_LEVELS or level in ("EXCEPTION", "SQLSTATE") else 1
        hi = self.read()[1]
        return Node("stmt" if level in RAISE_LEVELS else "throw", (lo, hi))

    def _dynamic(self) -> Node | None:
        t = self.tok(1)
        if self.dialect == "plpgsql":
            hidden = True
        elif t is None:
            hidden = False
        elif self.dialect == "db2":
            hidden = t.u == "IMMEDIATE"
        else:
            hidden = self.dialect == "tsql" and (
                t.kind == "str" or t.v == "(" or (t.v.startswith("@") and self.v(2) != "=") or t.u == "SP_EXECUTESQL" or t.v.upper().endswith(".SP_EXECUTESQL")
            )
        return Node("dynamic", self.read()) if hidden else None

    def _control(self) -> Node:
        t, lo = self.tok(), self.i
        self.i += 1
        node = Node("break" if t.u in ("BREAK", "LEAVE", "EXIT") else "continue", word=t.v)
        if self.u() and self.u() != "WHEN":
            node.target = self.v()
            self.i += 1
        if self.eat("WHEN"):
            node.when = self.read("cond")
        node.toks, node.span = (lo, self.i), (t.pos, self.t[self.i - 1].end)
        self.semis()
        return node

    def _goto(self) -> Node:
        t, lo, to = self.tok(), self.i, self.tok(1)
        self.i += 2
        node = Node("goto", (lo, min(lo + 2, len(self.t))), label=to.v if to else "?", span=(t.pos, (to or t).end))
        self.semis()
        return node

    # SQLite's RAISE
    def _raise_at(self, r: Range, i: int) -> Node | None:
        """A RAISE(action …) call that starts at i and ends inside r."""
        t = self.t
        if i + 3 >= r[1] or t[i].u != "RAISE" or t[i + 1].v != "(":
            return None
        action, after = t[i + 2].u, t[i + 3].v
        if not ((action in ("FAIL", "ABORT", "ROLLBACK") and after == ",") or (action == "IGNORE" and after == ")")):
            return None
        depth = 0
        for k in range(i + 1, r[1]):
            depth += {"(": 1, ")": -1}.get(t[k].v, 0)
            if depth == 0:
                return Node("sqlite_raise", (i, k + 1), word=action)
        return None

    def _top(self, r: Range, i: int, words: tuple[str, ...]) -> int:
        """The next of words outside parentheses and inner CASEs."""
        depth = cases = 0
        for k in range(i, r[1]):
            x = self.t[k]
            if x.v in "()":
                depth = max(0, depth + (1 if x.v == "(" else -1))
            elif depth:
                continue
            elif x.u == "CASE":
                cases += 1
            elif x.u == "END" and cases:
                cases -= 1
            elif not cases and x.u in words:
                return k
        return -1

    def _raises(self, lo: int, hi: int) -> bool:
        return any(t.u == "RAISE" for t in self.t[lo:hi])

    def _sqlite_raise(self, r: Range) -> Node | None:
        lo, hi = r
        if hi - lo < 2 or self.t[lo].u != "SELECT":
            return None
        if self.t[lo + 1].u == "CASE":
            return self._sqlite_case(r)
        found = self._raise_at(r, lo + 1)
        if not found or found.toks[1] == hi:
            return found
        end = found.toks[1]
        if self.t[end].u == "WHERE" and end + 1 < hi and not self._raises(end + 1, hi):
            return Node("if", cond=(end + 1, hi), parts=[("then", None, [found])])
        return None

    def _sqlite_case(self, r: Range) -> Node | None:
        lo, hi = r
        if hi - lo < 7 or self.t[lo + 2].u != "WHEN":
            return None
        node, i, count = Node("case"), lo + 2, 0

        def arm(a: int, b: int) -> list[Node] | None:
            found = self._raise_at(r, a)
            if found and found.toks[1] == b:
                return [found]
            return None if self._raises(a, b) else []

        while i < hi and self.t[i].u == "WHEN":
            then = self._top(r, i + 1, ("THEN",))
            after = self._top(r, then + 1, ("WHEN", "ELSE", "END")) if then > i + 1 else -1
            inner = arm(then + 1, after) if after > then + 1 else None
            if inner is None:
                return None
            count += len(inner)
            node.parts.append(("branch", (i + 1, then), inner))
            i = after
        if i < hi and self.t[i].u == "ELSE":
            end = self._top(r, i + 1, ("END",))
            inner = arm(i + 1, end) if end > i + 1 else None
            if inner is None:
                return None
            if inner:
                count += 1
                node.parts.append(("else", None, inner))
            i = end
        return node if node.parts and count and i == hi - 1 and self.t[i].u == "END" else None


@dataclass
class Parsed:
    header: Header
    toks: list[Tok]
    tree: list[Node]
    findings: list[Finding]
    consumed: int

    def text(self, r: Range | None) -> list[Tok]:
        return self.toks[r[0] : r[1]] if r else []


def parse(sql: str, dialect: str) -> Parsed:
    toks, findings = lex(sql)
    head = header(toks, dialect)
    if head.inner is not None:
        inner, more = lex(head.inner)
        body = [t._replace(pos=t.pos + head.offset, end=t.end + head.offset) for t in inner]
        findings += [f._replace(start=f.start + head.offset, end=f.end + head.offset) for f in more]
    else:
        body = toks[max(0, head.index) :]
    p = Parser(body, dialect)
    tree = p.block()
    while len(tree) == 1 and tree[0].kind == "block" and not tree[0].atomic:
        tree = tree[0].part("body")
    findings += p.findings
    rest = [t for t in body[p.i :] if t.v != ";"]
    if rest:
        if rest[0].u in ("END", "ELSE", "ELSEIF", "ELSIF", "WHEN", "EXCEPTION", "THEN", "UNTIL"):
            findings.append(Finding("warning", "unexpected_end", f'"{rest[0].u}" ends a block that was never opened.', rest[0].pos, rest[0].end))
        findings.append(Finding("error", "unconsumed_input", f"{len(rest)} tokens after the parsed part were not understood.", rest[0].pos, rest[-1].end))
        tree.append(Node("unknown", (p.i, len(body))))
    return Parsed(head, body, tree, findings, min(p.i, len(body)))


def flatten(tree: list[Node]) -> list[dict]:
    """Rows of the tree: node_id, parent_id, slot, ord, depth, pre, post, kind, label, target, toks and cond ranges."""
    rows: list[dict] = []
    clock = 0

    def visit(node: Node, parent: int | None, slot: str, ord_: int, depth: int) -> None:
        nonlocal clock
        row = {"node_id": len(rows), "parent_id": parent, "slot": slot, "ord": ord_, "depth": depth, "pre": clock, "kind": node.kind, "label": node.label, "target": node.target}
        row |= {"tok_lo": node.toks[0] if node.toks else None, "tok_hi": node.toks[1] if node.toks else None, "cond_lo": node.cond[0] if node.cond else None, "cond_hi": node.cond[1] if node.cond else None}
        rows.append(row)
        clock += 1
        k = 0
        for s, _, inner in node.parts:
            for child in inner:
                visit(child, row["node_id"], s, k, depth + 1)
                k += 1
        row["post"] = clock
        clock += 1

    for i, node in enumerate(tree):
        visit(node, None, "root", i, 0)
    return rows
