"""Fixed-layout report text to tables (O-07, O-08): cut a section, number its lines, one pattern per row layout."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def section(text, start: str, end: str) -> Column:
    """Everything between two anchors (to the end of the text when the second is missing)."""
    rest = F.when(F.instr(text, start) > 0, F.substring_index(text, start, -1)) if start else text
    return F.substring_index(rest, end, 1) if end else rest


def lines(docs: DataFrame, key: str, text: Column) -> DataFrame:
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def number(s) -> Column:
    """"−1,234%" -> -12.34 style cells: minus sign, thousands and percent cleaned; N/A is null."""
    t = F.regexp_replace(F.regexp_replace(F.trim(s), "−", "-"), "[,%]", "")
    return F.when(F.upper(t).isin("N/A", "-", ""), None).otherwise(t.try_cast("double"))


def feet(s) -> Column:
    """12' 6" -> 12.5."""
    f = F.regexp_extract(s, "(\\d+)\\s*'", 1).try_cast("double")
    i = F.regexp_extract(s, "(\\d+)\\s*\"", 1).try_cast("double")
    return F.when(f.isNotNull() | i.isNotNull(), F.coalesce(f, F.lit(0.0)) + F.coalesce(i, F.lit(0.0)) / 12)


def stitched(rows: DataFrame, key: str, first: str, extra: int) -> DataFrame:
    """O-08: rows that spread over several lines: the first matches ``first``, the next ``extra`` lines join it."""
    w = Window.partitionBy(key).orderBy("line_no")
    cols = [F.lead("line", k).over(w).alias(f"_l{k}") for k in range(1, extra + 1)]
    out = rows.select("*", *cols).filter(F.col("line").rlike(first))
    return out.withColumn("row", F.concat_ws(" ", "line", *[f"_l{k}" for k in range(1, extra + 1)])).drop(*[f"_l{k}" for k in range(1, extra + 1)])


# ---- whole tables of a report: sections in order, rows of one or more lines, typed cells -----------------

@dataclass(frozen=True)
class Layout:
    """A table of a report: it stands between two anchors (to the end without the second); a row is one match of ``lines`` on
    as many lines in a row, blank ones not counted.  ``fields`` name the groups of all lines in order: (name, kind), kind
    text, num, pct (a fraction), feet or skip."""
    section: str
    start: str
    end: str | None
    lines: tuple[str, ...]
    fields: tuple[tuple[str, str], ...]


#: Cells that say there is no value.
NO_VALUE = ("N/A", "-", "—", "")
ROWS = "section string, row_no int, line_no int, texts map<string,string>, numbers map<string,double>, bad array<string>"


def cell(raw: str, kind: str) -> tuple[float | None, bool]:
    """(value, whether the cell is bad) of a number, percentage or length as printed."""
    t = raw.strip().replace("−", "-").replace(",", "")
    if t.upper() in NO_VALUE:
        return None, False
    try:
        if kind == "feet":
            m = re.fullmatch(r"(?:(\d+(?:\.\d+)?)\s*')?\s*(?:(\d+(?:\.\d+)?)\s*\")?", t)
            if not m or not any(m.groups()):
                return None, True
            return float(m[1] or 0) + float(m[2] or 0) / 12, False
        v = float(t.removesuffix("%")) / (100 if kind == "pct" else 1)
        return (v, False) if math.isfinite(v) and (kind == "pct" or "%" not in t) else (None, True)
    except ValueError:
        return None, True


@udtf(returnType=ROWS)
class _Walk:
    """Walks one report: each section is looked for after the start of the one before; a section that is missing has no rows."""

    def eval(self, text: str, layouts: str):
        at = 0
        for spec in json.loads(layouts):
            s = (text or "").find(spec["start"], at)
            if s < 0:
                continue
            at = s + len(spec["start"])
            e = text.find(spec["end"], at) if spec["end"] else -1
            before = text.count("\n", 0, at)
            lines = [(before + k, x.strip()) for k, x in enumerate(text[at:e if e >= 0 else len(text)].split("\n")) if x.strip()]
            patterns, i, n = [re.compile(p) for p in spec["lines"]], 0, 0
            while i + len(patterns) <= len(lines):
                found = [p.search(x) for p, (_, x) in zip(patterns, lines[i:])]
                if not all(found):
                    i += 1
                    continue
                texts, numbers, bad = {}, {}, []
                for (name, kind), raw in zip(spec["fields"], (g for m in found for g in m.groups())):
                    if kind == "text":
                        texts[name] = (raw or "").strip()
                    elif kind != "skip":
                        numbers[name], wrong = cell(raw or "", kind)
                        bad += [name] if wrong else []
                n += 1
                yield spec["section"], n, lines[i][0], texts, numbers, bad
                i += len(patterns)


def report_rows(reports: DataFrame, key: str, text: str, layouts: Sequence[Layout]) -> DataFrame:
    """O-07: (key, section, row_no, line_no, texts, numbers, bad) of every row that a layout finds in a report.

    ``numbers`` has a null for a cell without a value and for one that cannot be read; ``bad`` names the latter.
    ``line_no`` counts the report's lines from 0.  A null text has no rows.  A lateral join: one report is walked at a time.
    """
    spec = json.dumps([asdict(x) for x in layouts])
    rows = reports.select(F.col(key).alias("_key"), F.col(text).alias("_text")).lateralJoin(_Walk(F.col("_text").outer(), F.lit(spec)))
    return rows.select(F.col("_key").alias(key), "section", "row_no", "line_no", "texts", "numbers", "bad")
