"""Texts made of tokens: joined, clipped, summarised; dotted names."""

from __future__ import annotations

from collections.abc import Sequence

from .lexer import Tok
from .vocab import CONTINUES

_GLUED_BEFORE = frozenset([",", ")", ".", ";", "::"])
_GLUED_AFTER = frozenset(["(", ".", "::"])
_SIGN_AFTER = frozenset("RETURN THROW WHEN THEN ELSE BY TOP".split())


def clip(text: str, most: int) -> str:
    return text if len(text) <= most else text[: most - 1].strip() + "…"


def _glued(toks: Sequence[Tok], i: int) -> bool:
    """Whether token i stands right after the one before it."""
    if i == 0:
        return True
    t, before = toks[i], toks[i - 1]
    if t.v in _GLUED_BEFORE or before.v in _GLUED_AFTER:
        return True
    if t.v == "(" and before.kind == "word" and before.u not in CONTINUES:
        return True
    if before.v in ("-", "+"):  # a sign, if nothing stands before it that could be its left side
        left = toks[i - 2] if i >= 2 else None
        return left is None or (left.kind == "op" and left.v != ")") or (left.kind == "word" and left.u in _SIGN_AFTER)
    return False


def joined(toks: Sequence[Tok], most: int | None = None) -> str:
    parts: list[str] = []
    size = 0
    for i, t in enumerate(toks):
        parts.append(t.v if _glued(toks, i) else " " + t.v)
        size += len(parts[-1])
        if most and size > most + 40:
            break
    return "".join(parts).strip()


def dotted(toks: Sequence[Tok], i: int) -> str:
    """The name that starts at token i: whatever follows a dot belongs to it."""
    if i >= len(toks):
        return ""
    name, k = toks[i].v, i + 1
    while k + 1 < len(toks) and toks[k].v == ".":
        name += "." + toks[k + 1].v
        k += 2
    return name


def word_at(toks: Sequence[Tok], i: int) -> str:
    return toks[i].u if 0 <= i < len(toks) else ""


def top_level(toks: Sequence[Tok], word: str) -> int:
    """The first place of a word outside parentheses, or -1."""
    depth = 0
    for i, t in enumerate(toks):
        if t.v == "(":
            depth += 1
        elif t.v == ")":
            depth -= 1
        elif depth == 0 and t.u == word:
            return i
    return -1


def first_of(toks: Sequence[Tok], word: str, start: int) -> int:
    return next((i for i in range(start, len(toks)) if toks[i].u == word), -1)


def _insert(toks: Sequence[Tok], most: int) -> str:
    i = 1
    while word_at(toks, i) in ("INTO", "OR", "IGNORE", "REPLACE"):
        i += 1
    return "INSERT INTO " + dotted(toks, i)


def _call(toks: Sequence[Tok], most: int) -> str:
    i = 3 if dotted(toks, 1).startswith("@") and len(toks) > 2 and toks[2].v == "=" else 1
    verb = toks[0].u if toks[0].u in ("PERFORM", "CALL") else "EXEC"
    return f"{verb} {dotted(toks, i)}"


def _select(toks: Sequence[Tok], most: int) -> str:
    into, source = top_level(toks, "INTO"), top_level(toks, "FROM")
    if into >= 0:
        return "SELECT … INTO " + dotted(toks, into + 1)
    if dotted(toks, 1).startswith("@"):
        return clip(joined(toks[: source if source > 0 else 6]), most)
    return "SELECT … FROM " + dotted(toks, source + 1) if source >= 0 else ""


def _declare(toks: Sequence[Tok], most: int) -> str:
    if first_of(toks, "CURSOR", 2) >= 0:
        return "DECLARE CURSOR " + dotted(toks, 1)
    names = [t.v for j, t in enumerate(toks) if j and t.v.startswith("@") and (j == 1 or toks[j - 1].v == ",")][:4]
    return "DECLARE " + ", ".join(names) + (" …" if len(names) > 3 else "") if names else ""


def _grant(toks: Sequence[Tok], most: int) -> str:
    on = top_level(toks, "ON")
    return f"{toks[0].u} … ON {dotted(toks, on + 1)}" if on > 0 else ""


def _fetch(toks: Sequence[Tok], most: int) -> str:
    source = first_of(toks, "FROM", 1)
    return "FETCH FROM " + dotted(toks, source + 1) if source > 0 else ""


def _update(toks: Sequence[Tok], most: int) -> str:
    return "UPDATE " + dotted(toks, 3 if word_at(toks, 1) in ("TOP", "OR") else 1)


_BY_HEAD = {
    **dict.fromkeys(("INSERT", "REPLACE"), _insert),
    "UPDATE": _update,
    "DELETE": lambda t, m: "DELETE FROM " + dotted(t, 2 if word_at(t, 1) == "FROM" else 1),
    "MERGE": lambda t, m: "MERGE " + dotted(t, 2 if word_at(t, 1) == "INTO" else 1),
    **dict.fromkeys(("EXEC", "EXECUTE", "CALL", "PERFORM"), _call),
    "SELECT": _select,
    "DECLARE": _declare,
    **dict.fromkeys(("GRANT", "REVOKE", "DENY"), _grant),
    "WAITFOR": lambda t, m: "WAITFOR " + clip(joined(t[1:], m - 8), m),
    **dict.fromkeys(("KILL", "OPEN", "CLOSE", "DEALLOCATE", "ALLOCATE"), lambda t, m: f"{t[0].u} {dotted(t, 1)}"),
    "FETCH": _fetch,
}


def summary(toks: Sequence[Tok], most: int) -> str:
    """A short label of a statement, by its first word."""
    rule = _BY_HEAD.get(toks[0].u) if toks else None
    return clip((rule and rule(toks, most)) or joined(toks, most), most)


def span(toks: Sequence[Tok] | None) -> tuple[int, int] | None:
    return (toks[0].pos, toks[-1].end) if toks else None
