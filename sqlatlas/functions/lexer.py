"""The lexer: one alternation that covers every character, read alike by Java and by Python.

``tokens`` is the DataFrame form (JVM only: one regular expression a row, then a window for offsets). ``lex`` is the form for the
per-object parser. Offsets are code points. Nested comments are matched to ``DEPTH`` levels by the expression; ``lex`` counts
them, and ``tokens`` sends only texts with more opening marks than that through it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEPTH = 8
_END = r"(?![\s\S])"


def _comment(depth: int) -> str:
    inner = r"[^*/]++|\*(?!/)|/(?!\*)"
    return rf"/\*(?:{inner}{'|' + _comment(depth - 1) if depth else ''})*+\*/"


def _quoted(opening: str, closing: str) -> str:
    return rf"{opening}(?:[^{closing}]++|{closing}{closing})*+(?:{closing}|{_END})"


_EXPONENT = r"(?:[eE][+-]?[0-9]+)?"
_TAIL = rf"(?:\.(?!\.)[0-9]*)?{_EXPONENT}"
_OPERATORS = r"<=|>=|<>|!=|!<|!>|\+=|-=|\*=|/=|\|\||<<|>>|->|=>|:="
PARTS = (
    r"[ \t\r\n]+",
    r"--[^\n]*",
    _comment(DEPTH - 1),
    r"/\*[\s\S]*",
    rf"(\$[A-Za-z_]*\$)[\s\S]*?(?:\1|{_END})",
    rf"[Ee]'(?:[^'\\]++|\\[\s\S]|\\|'')*+(?:'|{_END})",
    "[NnBbXx]?" + _quoted("'", "'"),
    _quoted(r"\[", r"\]"),
    _quoted('"', '"'),
    _quoted("`", "`"),
    r"(?:::|[A-Za-z_@#])[A-Za-z_@#$0-9]*",
    rf"(?:0[xX][0-9a-fA-F]*|[0-9]+{_TAIL}|\.[0-9]+{_TAIL})(?:_[0-9a-fA-F]+)*",
    _OPERATORS,
    r"[\s\S]",
)
LEXEME = "|".join(PARTS)
_LEXEME = re.compile(LEXEME)


class Tok(NamedTuple):
    kind: str
    v: str
    u: str
    nl: bool
    pos: int
    end: int


class Finding(NamedTuple):
    severity: str
    code: str
    message: str
    start: int | None
    end: int | None
    scope: str = "region"


def _comment_end(text: str, at: int) -> tuple[int, bool]:
    """End of the block comment that opens at ``at``, and whether it is closed."""
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end(), True
    return len(text), False


def kind_of(lexeme: str) -> str:
    """word, op, str, num, dollar; or skip."""
    c, d = lexeme[0], lexeme[1:2]
    if c in " \t\r\n" or lexeme.startswith(("--", "/*")):
        return "skip"
    if c == "$" and len(lexeme) > 1:
        return "dollar"
    if c == "'" or (d == "'" and c in "NnEeBbXx"):
        return "str"
    if c in '["`@#_' or (c.isascii() and c.isalpha()) or lexeme.startswith("::"):
        return "word"
    return "num" if c in "0123456789" or (c == "." and d and d in "0123456789") else "op"


_CLOSERS = {"[": "]", '"': '"', "`": "`"}


def _open_ended(lexeme: str, kind: str) -> str | None:
    """The code of a literal or identifier that the text ends inside of."""
    if kind == "dollar":
        tag = re.match(r"\$[A-Za-z_]*\$", lexeme)[0]
        return None if lexeme.endswith(tag) and len(lexeme) >= 2 * len(tag) else "unterminated_dollar_quote"
    if kind == "str":
        body = lexeme[lexeme.index("'") + 1 :]
        if lexeme[0] in "Ee":
            body = re.sub(r"\\[\s\S]", "", body)
        return None if len(body) - len(body.rstrip("'")) & 1 else "unterminated_string"
    if kind == "word" and (close := _CLOSERS.get(lexeme[0])):
        body = lexeme[1:]
        return None if len(body) - len(body.rstrip(close)) & 1 else "unterminated_identifier"
    return None


MESSAGES = {
    "unterminated_comment": "A block comment runs to the end of the text.",
    "unterminated_dollar_quote": "A dollar-quoted body runs to the end of the text.",
    "unterminated_string": "A string literal runs to the end of the text.",
    "unterminated_identifier": "A quoted identifier runs to the end of the text.",
    "unexpected_closing_parenthesis": "This closing parenthesis closes nothing.",
    "unclosed_parenthesis": "This opening parenthesis is never closed.",
}


def lex(text: str) -> tuple[list[Tok], list[Finding]]:
    toks: list[Tok] = []
    found: list[Finding] = []

    def report(code: str, a: int, b: int) -> None:
        found.append(Finding("error", code, MESSAGES[code], a, max(a + 1, min(len(text), b))))

    at, nl = 0, True
    while at < len(text):
        if text.startswith("/*", at):
            end, closed = _comment_end(text, at)
            if not closed:
                report("unterminated_comment", at, len(text))
            nl = nl or "\n" in text[at:end]
            at = end
            continue
        v = _LEXEME.match(text, at)[0]
        kind, end = kind_of(v), at + len(v)
        if kind == "skip":
            nl = nl or "\n" in v
        else:
            if code := _open_ended(v, kind):
                report(code, at, len(text) if kind == "dollar" else len(text))
            toks.append(Tok(kind, v, v.upper() if kind == "word" else v, nl, at, end))
            nl = False
        at = end
    opened: list[Tok] = []
    for t in toks:
        if t.v == "(":
            opened.append(t)
        elif t.v == ")":
            if opened:
                opened.pop()
            else:
                report("unexpected_closing_parenthesis", t.pos, t.end)
    for t in opened:
        report("unclosed_parenthesis", t.pos, t.end)
    return toks, found


# --- DataFrame form ------------------------------------------------------------------------------


def _kind(v: Column) -> Column:
    c, d = F.substring(v, 1, 1), F.substring(v, 2, 1)
    return (
        F.when(c.isin(" ", "\t", "\r", "\n") | v.startswith("--") | v.startswith("/*"), "skip")
        .when((c == "$") & (F.length(v) > 1), "dollar")
        .when((c == "'") | ((d == "'") & c.isin(*"NnEeBbXx")), "str")
        .when(c.rlike(r'^[\["`@#_A-Za-z]') | v.startswith("::"), "word")
        .when(c.rlike("^[0-9]") | ((c == ".") & d.rlike("^[0-9]")), "num")
        .otherwise("op")
    )


def tokens(texts: DataFrame, key: str = "unit_id", text: str = "sql") -> DataFrame:
    """key, ord, kind, v, u, nl, pos, end: the tokens of every row of texts (key unique, null text empty)."""
    body = F.coalesce(F.col(text), F.lit(""))
    deep = (F.length(body) - F.length(F.replace(body, F.lit("/*"), F.lit("")))) > 2 * DEPTH
    flat = texts.select(key, body.alias("__t"), deep.alias("__deep"))
    cut = flat.filter("not __deep").select(key, F.posexplode(F.regexp_extract_all("__t", F.lit(LEXEME), F.lit(0))).alias("i", "v"))
    own = Window.partitionBy(key).orderBy("i")
    sized = cut.withColumn("end", F.sum(F.length("v")).over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("kind", _kind(F.col("v")))
    lines = F.sum(F.when((F.col("kind") == "skip") & F.col("v").contains("\n"), 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, 0))
    kept = sized.withColumn("lines", lines).filter("kind <> 'skip'")
    kept = kept.withColumns({"ord": F.row_number().over(own) - 1, "before": F.lag("lines").over(own)})
    plain = kept.select(
        key, "ord", "kind", "v", F.when(F.col("kind") == "word", F.upper("v")).otherwise(F.col("v")).alias("u"),
        (F.col("before").isNull() | (F.col("before") < F.col("lines"))).alias("nl"), (F.col("end") - F.length("v")).cast("int").alias("pos"), F.col("end").cast("int").alias("end"),
    )
    return plain.unionByName(_lexed(flat.filter("__deep"), key))


def _lexed(texts: DataFrame, key: str) -> DataFrame:
    names = ["ord", "kind", "v", "u", "nl", "pos", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k.as_py(), i, *t) for k, x in zip(batch.column(key), batch.column("__t"), strict=True) for i, t in enumerate(lex(x.as_py())[0])]
            kinds = batch.schema.field(key).type, pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [key, *names])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "__t").mapInArrow(run, f"{key} {kind}, ord int, kind string, v string, u string, nl boolean, pos int, end int")


def parenthesis_findings(toks: DataFrame, key: str = "unit_id") -> DataFrame:
    """key, code, pos: a ')' at a new minimum of the running balance; a '(' after which the balance never falls below its own."""
    own = Window.partitionBy(key).orderBy("ord")
    step = F.when(F.col("v") == "(", 1).when(F.col("v") == ")", -1).otherwise(0)
    b = toks.filter("v in ('(', ')')").withColumn("b", F.sum(step).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    low = F.min("b").over(own.rowsBetween(Window.unboundedPreceding, -1))
    later = F.min("b").over(own.rowsBetween(1, Window.unboundedFollowing))
    b = b.withColumns({"low": F.least(F.coalesce(low, F.lit(0)), F.lit(0)), "later": later})
    code = F.when((F.col("v") == ")") & (F.col("b") < F.col("low")), "unexpected_closing_parenthesis").when((F.col("v") == "(") & (F.coalesce("later", F.col("b")) >= F.col("b")), "unclosed_parenthesis")
    return b.withColumn("code", code).filter("code is not null").select(key, "code", "pos")
