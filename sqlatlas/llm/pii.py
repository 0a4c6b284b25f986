r"""PII by a semi-Markov conditional random field over candidate segments.

Base spans follow the fixed patterns of each kind and always stay. Around places that may hold more (a spelled-out ``name at host dot
tld``, a phone number without ``+``, a card number with other separators, an address with spaced dots), a window of the text is cut into
tokens; segments of at most ``MOST_TOKENS`` tokens are scored as a whole by the kind's features (shape, number of
digits, checks such as Luhn, cue words before it), all other tokens as outside. Dynamic programming over token positions finds the best
segmentation, with as many entities as the window holds, choosing boundaries and kinds jointly. Segments that touch a base span are
left out. Weights are fitted here, by stochastic gradient on the model's likelihood, from sentences made by rule with known spans.

Null text counts as empty. Empty texts have no spans. Rows are judged by themselves: ties, repeated rows and extra columns have no
influence. An empty table gives no rows. Texts of any length are searched whole; only windows around candidates are cut, and windows
that touch are one, so no candidate lies across an edge.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS, REACH = 24, 60
MOST_DIGITS = 40  # characters of the longest ip, card or phone shape

# fixed values: the base patterns of the contract
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match begins and ends with whole runs of digits, so runs are taken whole and once
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each '@': the local part reaches back to the last match or a foreign character."""
    floor, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > floor and text[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            yield lo, m.end()
            floor = m.end()
        at = text.find("@", max(at + 1, floor))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _byte(part: str) -> bool:
    """Whether digits (of any number of leading zeros) are at most 255."""
    own = part.lstrip("0")
    return len(own) < 4 and int(own or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in order of start, then of kind."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
        out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# --- candidates and their features --------------------------------------------------------------

_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
_AT_TAIL = r" ?(?:@|[\[({] ?at ?[\])}]| at ) ?[a-z0-9-]+(?: ?(?:\.|[\[({] ?dot ?[\])}]| dot ) ?[a-z0-9-]+)+"
_SHAPES = {
    "email": re.compile(rf"[a-z0-9._+-]+{_AT_TAIL}", re.I),
    "ip": re.compile(r"[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9]{4}(?:[ ./-]{0,3}[0-9]{2,6}){2,4}"),
    "phone": re.compile(r"(?:\+|00)?[ ]?(?:[0-9]{1,3}[ .-])?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}"),
}
#: Where candidates are: the shapes themselves. Of an e-mail only what follows its local part, so that long words are passed once.
_TRIGGERS = (re.compile(rf"(?<=[a-z0-9._+-]){_AT_TAIL}", re.I), *(_SHAPES[k] for k in ("ip", "card", "phone")))
_MAYBE_AT = re.compile(r"@|\bat\b", re.I)
_CUES = {
    "email": {"email", "mail", "contact", "write"},
    "ip": {"ip", "address", "host", "server"},
    "card": {"card", "visa", "credit", "pay"},
    "phone": {"phone", "tel", "call", "mobile", "fax"},
}
_FEATURES = 13


def _goes_on(beside: str) -> bool:
    """Whether what stands beside a segment (nearest character first) continues it."""
    return beside[:1].isalnum() or (beside[:1] in ("-", ".", "/", "_", "+") and beside[1:].isalnum())


def features(text: str, lo: int, hi: int, kind: str, before: set[str]) -> np.ndarray:
    """Of the whole segment text[lo:hi] as one entity of this kind."""
    own = text[lo:hi].lower()
    digits = _digits(own)
    f = np.zeros(_FEATURES)
    f[0] = 1
    f[1] = bool(_SHAPES[kind].fullmatch(own))
    f[2] = not f[1]
    f[3] = bool(before & _CUES[kind])
    f[4] = {"card": 12 <= len(digits) <= 19, "phone": 9 <= len(digits) <= 15, "ip": 4 <= len(digits) <= 12, "email": own.count("dot") + own.count(".") > 0}[kind]
    f[5] = kind == "card" and luhn(digits or "1")
    f[6] = kind == "card" and not f[5]
    f[7] = kind == "ip" and all(int(x) <= 255 for x in re.findall("[0-9]+", own)[:8])
    f[8] = kind == "phone" and ("(" in own or own[:1] == "+" or own.count("-") >= 2 or own.count(".") == 2)
    f[9] = _goes_on(text[max(0, lo - 2) : lo][::-1]) or _goes_on(text[hi : hi + 2])
    f[10] = kind == "email" and bool(re.search(r"[\[({] ?at|@", own))
    f[11] = kind == "phone" and own.isdigit()
    f[12] = kind == "email" and not f[10] and ". " in own  # a sentence that ends after "at"
    return f


def disjoint(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(b, ends[-1])
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


class Window:
    """A piece of text cut into tokens, with its candidate segments (first token, last + 1, kind, features)."""

    def __init__(self, text: str, lo: int, hi: int, taken: list[tuple[int, int]]):
        self.tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, lo, hi)]
        self.segments: list[tuple[int, int, int, np.ndarray]] = []
        starts, ends = disjoint(taken)
        words = [text[a:b].lower() for a, b in self.tokens]
        ats = [i for i, w in enumerate(words) if w in ("@", "at")]
        for i, (a, _) in enumerate(self.tokens):
            letters, at = words[i].isalpha(), words[i] in ("@", "at")
            before, next_at = None, bisect_left(ats, i)
            for j in range(i + 2, min(len(self.tokens), i + MOST_TOKENS) + 1):
                own = words[j - 1]
                letters, at = letters or own.isalpha(), at or own in ("@", "at")
                if not own[-1].isalnum():  # every shape ends with a letter or a digit
                    continue
                b = self.tokens[j - 1][1]
                if b - a > MOST_DIGITS and not at and (next_at == len(ats) or ats[next_at] >= i + MOST_TOKENS):
                    break
                last = bisect_left(starts, b) - 1
                if last >= 0 and a < ends[last]:
                    break
                for k, kind in enumerate(KINDS):
                    if (at if kind == "email" else not letters and b - a <= MOST_DIGITS) and _SHAPES[kind].fullmatch(text, a, b):
                        if before is None:
                            before = set(words[max(0, i - 4) : i])
                        self.segments.append((i, j, k, features(text, a, b, kind, before)))


def decode(window: Window, weights: np.ndarray, most: int | None = None) -> list[tuple[int, int, int]]:
    """The best segmentation (with at most ``most`` entities, if given): (first token, last + 1, kind)."""
    n = len(window.tokens)
    by_end: dict[int, list] = {}
    for i, j, k, f in window.segments:
        by_end.setdefault(j, []).append((i, k, float(weights[k] @ f)))
    if most is None:
        return _decode_all(n, by_end)
    best = np.full((n + 1, most + 1), -np.inf)
    best[0, 0] = 0
    back: dict[tuple[int, int], tuple[int, int]] = {}
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, k, s in by_end.get(j, ()):
            for e in range(1, most + 1):
                if best[i, e - 1] + s > best[j, e]:
                    best[j, e] = best[i, e - 1] + s
                    back[j, e] = (i, k)
    out, j, e = [], n, int(best[n].argmax())
    while j and e:
        if (j, e) in back and best[j, e] != best[j - 1, e]:
            i, k = back[j, e]
            out.append((i, j, k))
            j, e = i, e - 1
        else:
            j -= 1
    return out[::-1]


def _decode_all(n: int, by_end: dict[int, list]) -> list[tuple[int, int, int]]:
    """The best segmentation of n tokens by segments (first token, kind, score) by end, in one pass: its time grows with the window only."""
    best = [0.0] * (n + 1)
    back: list[tuple[int, int] | None] = [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, k, s in by_end.get(j, ()):
            # of equal ones, the longest: the last end, then the first start
            if best[i] + s > best[j] or (s > 0 and back[j] is None and best[i] + s == best[j]):
                best[j], back[j] = best[i] + s, (i, k)
    out, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            i, k = back[j]
            out.append((i, j, k))
            j = i
    return out[::-1]


def expected(window: Window, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """log Z and the expected features by kind, by the forward and backward sums over segments."""
    n = len(window.tokens)
    scored = [(i, j, k, f, float(weights[k] @ f)) for i, j, k, f in window.segments]
    ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = behind[n] = 0
    for j in range(1, n + 1):
        ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[i] + s for i, e, _, _, s in scored if e == j)])
    for i in range(n - 1, -1, -1):
        behind[i] = np.logaddexp.reduce([behind[i + 1], *(behind[j] + s for b, j, _, _, s in scored if b == i)])
    total = np.zeros_like(weights)
    for i, j, k, f, s in scored:
        total[k] += math.exp(ahead[i] + s + behind[j] - ahead[n]) * f
    return ahead[n], total


def made_up(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A sentence by rule with the spans that the base patterns miss, or with look-alikes that are none."""
    word = lambda: "".join(rng.choice("aeioustnrlmdc") for _ in range(rng.randint(2, 8)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    text, spans = " ".join(word() for _ in range(rng.randint(1, 5))) + " ", []
    for _ in range(rng.randint(1, 3)):
        kind = rng.choice([*KINDS, "none", "none"])
        cue = rng.choice(["", "", *sorted(_CUES.get(kind, {"item"}))])
        text += f"{cue} " if cue else ""
        if kind == "email":
            at, dot = rng.choice([(" at ", " dot "), (" [at] ", "."), ("(at)", "."), (" [at] ", " [dot] ")])
            own = word() + rng.choice(["", "." + word()]) + at + word() + dot + rng.choice(["com", "org", "net"])
        elif kind == "ip":
            own = " . ".join(str(rng.randint(0, 255)) for _ in range(4))
        elif kind == "card":
            d = rng.choice("345") + num(14)
            d += next(c for c in "0123456789" if luhn(d + c))
            own = rng.choice([".", " - ", "/"]).join(d[i : i + 4] for i in range(0, 16, 4))
        elif kind == "phone":
            own = rng.choice([rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format(num(3), num(3), num(4)), f"00{num(2)} {num(3)} {num(6)}"])
        else:
            own = rng.choice([num(10), num(11), f"{num(4)} {num(4)}", f"{num(4)}-{num(2)}-{num(2)}", f"{num(3)}, {num(3)}, {num(4)}", f"{num(4)} {num(4)} {num(4)}", f"{num(3)}-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"{word()} at {word()}", f"{word()} at {word()}. {word().title()}", f"300 . {num(3)} . 999 . 1", ".".join((num(4), num(4), num(4), "9" + num(4)))])
        if kind != "none":
            spans.append((kind, len(text), len(text) + len(own)))
        text += own + " " + " ".join(word() for _ in range(rng.randint(1, 4))) + ". "
    return text, spans


@cache
def trained(sentences: int = 400, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Weights by kind, from made-up sentences."""
    rng = random.Random(seed)
    cases = []
    for _ in range(sentences):
        text, spans = made_up(rng)
        window = Window(text, 0, len(text), [(a, b) for _, a, b in base_spans(text)])
        gold = np.zeros((len(KINDS), _FEATURES))
        real = {(a, b, KINDS.index(k)) for k, a, b in spans}
        for i, j, k, f in window.segments:
            if (window.tokens[i][0], window.tokens[j - 1][1], k) in real:
                gold[k] += f
        cases.append((window, gold))
    weights = np.zeros((len(KINDS), _FEATURES))
    for r in range(rounds):
        rng.shuffle(cases)
        for window, gold in cases:
            weights += 0.4 / (1 + r) * (gold - expected(window, weights)[1] - 0.002 * weights)
    return weights


def triggers(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Ranges around which candidates lie, in order of start: matches of the shapes, but for those inside a base span of their kind."""
    mail = {end: start for kind, start, end in base if kind == "email"}
    out = []
    if _MAYBE_AT.search(text):
        for m in _TRIGGERS[0].finditer(text):
            lo = m.start()
            if mail.get(m.end(), lo) < lo:
                continue
            while lo and text[lo - 1] in _LOCAL:
                lo -= 1
            out.append((lo, m.end()))
    if _DIGIT.search(text):
        out += [m.span() for t in _TRIGGERS[1:] for m in t.finditer(text)]
    return sorted(out)


def all_spans(text: str, weights: np.ndarray) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, base and added spans)."""
    base = base_spans(text)
    found = triggers(text, base)
    if not found:
        return base, base
    taken = [(a, b) for _, a, b in base]
    added: list[tuple[str, int, int]] = []
    merged: list[list[int]] = []
    for lo, hi in ((max(0, a - REACH), b + REACH) for a, b in found):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(hi, merged[-1][1])
        else:
            merged.append([lo, hi])
    first = 0
    for lo, hi in merged:
        while 0 < lo < len(text) and text[lo - 1].isalnum() and text[lo].isalnum():  # windows begin between words
            lo += 1
        while first < len(taken) and taken[first][1] <= lo:  # spans that end before this window and all later ones
            first += 1
        near = [(a, b) for a, b in taken[first : bisect_left(taken, (hi,))] if lo < b]
        window = Window(text, lo, min(hi, len(text)), near)
        if window.segments:
            added += [(KINDS[k], window.tokens[i][0], window.tokens[j - 1][1]) for i, j, k in decode(window, weights)]
    return base, sorted({*base, *added}, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans of every row; the numbers by kind are of base spans, n_spans is of all."""
    held = docs.sparkSession.sparkContext.broadcast(trained() if weights is None else weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [all_spans(x.as_py() or "", held.value) for x in batch.column("text")]
            numbers = [pa.array([sum(k == kind for k, _, _ in base) for base, _ in rows], pa.int64()) for kind in KINDS]
            shas = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, shas, pa.array([joined(spans) for _, spans in rows], pa.string()), pa.array([len(spans) for _, spans in rows], pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
