"""Catalogues of known objects: parsed from JSON or lines, indexed with conflicts, resolved by join or by lookup.

A catalogue describes a database's objects, so it is metadata of bounded size (``MOST_OBJECTS``; more raises). Its index
is order-dependent (first name wins), and is built once on the driver; references of any number resolve by a join with it.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexer import Finding
from ..functions.vocab import CATALOGUE_KINDS

MOST_OBJECTS = 1_000_000
MOST_SUFFIXES = 8


def normal_name(name: object) -> str:
    return re.sub(r"\s+", " ", re.sub(r'[\[\]"`]', "", "" if name is None else str(name)).strip().upper())


def normal_kind(kind: object) -> str:
    k = "" if kind is None else str(kind).strip().upper()
    k = "PROC" if k == "PROCEDURE" else k
    return k if k in CATALOGUE_KINDS else "OTHER"


def normal_column(name: Column) -> Column:
    """``normal_name`` of a column."""
    return F.regexp_replace(F.trim(F.upper(F.regexp_replace(F.coalesce(name, F.lit("")), r'[\[\]"`]', ""))), r"\s+", " ")


@dataclass
class Catalogue:
    objects: list[tuple[str, str, list[str]]] = field(default_factory=list)  # name, kind, synonyms
    columns: list[tuple[str, str]] = field(default_factory=list)  # table, name
    findings: list[Finding] = field(default_factory=list)
    format: str = "text"

    def __post_init__(self) -> None:
        if len(self.objects) > MOST_OBJECTS:
            raise ValueError(f"a catalogue holds at most {MOST_OBJECTS} objects")
        self.by_name: dict[str, int] = {}
        self.by_synonym: dict[str, int] = {}
        self.conflicts: dict[str, None] = {}
        for i, (name, _, synonyms) in enumerate(self.objects):
            n = normal_name(name)
            if not n:
                continue
            if n in self.by_name or n in self.by_synonym:
                self.conflicts[n] = None
                continue
            self.by_name[n] = i
            for s in filter(None, map(normal_name, synonyms)):
                if self.by_synonym.get(s, i) != i or s in self.by_name:
                    self.conflicts[s] = None
                else:
                    self.by_synonym[s] = i

    def resolve(self, name: str) -> tuple[str, str | None]:
        """(verified, conflict or external; canonical name)."""
        n = normal_name(name)
        if n in self.conflicts:
            return "conflict", None
        i = self.by_name.get(n, self.by_synonym.get(n))
        return ("external", None) if i is None or not n else ("verified", self.objects[i][0])

    def suffixes(self, name: str) -> list[str]:
        """Catalogue names that the name ends in, after a dot; at most MOST_SUFFIXES (a report), in catalogue order."""
        n = normal_name(name)
        tails = {n[i + 1 :] for i, c in enumerate(n) if c == "."} - {""}
        found = [(o[0], o[1]) for o in self.objects if normal_name(o[0]) in tails] if tails else []
        return list({(o.upper(), k): o for o, k in reversed(found)}.values())[::-1][:MOST_SUFFIXES]

    @property
    def summary(self) -> str:
        def many(n: int, what: str) -> list[str]:
            return [f"{n} {what}{'' if n == 1 else 's'}"] if n else []

        return ", ".join(many(len(self.objects), "object") or ["0 objects"]) + "".join(f", {x}" for x in many(len(self.columns), "column") + many(len(self.conflicts), "conflict"))


def _from_json(text: str) -> Catalogue:
    try:
        raw = json.loads(text)
    except ValueError as e:
        return Catalogue(findings=[Finding("error", "catalogue_parse_error", f"The catalogue is not JSON: {e}", None, None, "document")], format="json")
    whole = raw if isinstance(raw, dict) else {"objects": raw}
    entries, columns = (x if isinstance(x, list) else [] for x in (whole.get("objects"), whole.get("columns")))
    objects, seen = [], set()
    for e in entries:
        if isinstance(e, str):
            objects.append((e, "OTHER", []))
        elif isinstance(e, dict) and e.get("name") and normal_name(e["name"]) not in seen:
            seen.add(normal_name(e["name"]))
            s = e.get("synonyms")
            objects.append((str(e["name"]), normal_kind(e.get("kind")), [str(x) for x in s] if isinstance(s, list) else [s] if isinstance(s, str) and s else []))
    return Catalogue(objects, [(str(c["table"]), str(c["name"])) for c in columns if isinstance(c, dict) and c.get("table") and c.get("name")], format="json")


def _from_lines(text: str) -> Catalogue:
    objects, columns = [], []
    for line in map(str.strip, re.split(r"\r?\n", text)):
        if not line or line.startswith(("#", "//")):
            continue
        if line.upper().startswith(("COL ", "COLUMN ")):
            table, _, name = "".join(line.split()[1:]).rpartition(".")
            columns.append((table, name))
            continue
        name, *rest = [x for x in re.split(r"[\s,]+", line) if x]
        kind = normal_kind(rest[0]) if rest and normal_kind(rest[0]) != "OTHER" else None
        objects.append((name, kind or "OTHER", rest[1:] if kind else rest))
    return Catalogue(objects, columns)


def parse_catalogue(text: str | None, format: str | None = None) -> Catalogue:
    text = (text or "").strip()
    cat = _from_json(text) if (format or ("json" if text[:1] in ("{", "[") else "text")) == "json" else _from_lines(text)
    for n in cat.conflicts:
        shown = cat.objects[cat.by_name[n]][0] if n in cat.by_name else n
        cat.findings.append(Finding("warning", "catalogue_conflict", f'Several catalogue entries claim "{shown}"; references to it stay unresolved.', None, None, "document"))
    if cat.format == "text" and not cat.objects and not cat.columns:
        cat.findings.append(Finding("warning", "catalogue_empty", "The catalogue holds no objects.", None, None, "document"))
    return cat


def index_frame(spark: SparkSession, cat: Catalogue) -> DataFrame:
    """norm, resolution, canonical: one row per name, synonym or conflict."""
    rows = {n: ("verified", cat.objects[i][0]) for n, i in (cat.by_synonym | cat.by_name).items()} | dict.fromkeys(cat.conflicts, ("conflict", None))
    return spark.createDataFrame([(n, *r) for n, r in rows.items()], "norm string, resolution string, canonical string")


def resolved(refs: DataFrame, index: DataFrame, name: str = "name") -> DataFrame:
    """refs with resolution and canonical."""
    found = refs.withColumn("norm", normal_column(F.col(name))).join(index, "norm", "left").drop("norm")
    return found.withColumn("resolution", F.coalesce("resolution", F.lit("external")))


def suffix_matches(refs: DataFrame, objects: DataFrame, name: str = "name", key: str = "ref_id") -> DataFrame:
    """key, candidate, rank: catalogue objects (norm, ord, canonical) that a reference ends in after a dot.

    All proper suffixes of a reference are listed and joined by equality, so no pair of names is compared in vain.
    """
    parts = F.split(normal_column(F.col(name)), r"\.")
    tails = refs.select(key, F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.when(i <= F.size(parts), F.array_join(F.slice(parts, i, F.size(parts)), ".")))).alias("norm")).filter("norm <> ''")
    found = tails.join(objects, "norm")
    from pyspark.sql import Window

    return found.select(key, F.col("canonical").alias("candidate"), F.row_number().over(Window.partitionBy(key).orderBy("ord")).alias("rank")).filter(F.col("rank") <= MOST_SUFFIXES)
