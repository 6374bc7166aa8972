"""Text laid out in fields: labels, wrapped lines, name lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PAIRS = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("value", T.StringType())]))


def labelled(text: str, labels: list[str]) -> list[tuple[str, str]]:
    """Values of labels of one page: after the label on its line, else on the lines below up to
    the next label, else (for a label at the end) on the line above."""
    lines = [x.strip() for x in text.split("\n")]
    at = {}
    for i, line in enumerate(lines):
        for name in labels:
            if re.match(rf"{re.escape(name)}\s*(:|$)", line, re.I):
                at[i] = name
    out = []
    for i, name in sorted(at.items()):
        value = re.sub(rf"^{re.escape(name)}\s*:?\s*", "", lines[i], flags=re.I)
        if not value:
            below = []
            for j in range(i + 1, len(lines)):
                if j in at or not lines[j]:
                    break
                below.append(lines[j])
            value = " ".join(below)
        if not value and i > 0 and i - 1 not in at:
            value = lines[i - 1]
        out.append((name, value))
    return out


def sections(pages: DataFrame, labels: list[str]) -> DataFrame:
    """page, label, value of pages (page, text)."""

    @F.pandas_udf(_PAIRS)
    def parse(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [{"label": a, "value": b} for a, b in labelled(t or "", labels)])

    return pages.select("page", F.explode(parse("text")).alias("p")).select("page", "p.label", "p.value")


def joined_lines(lines: list[str], width: int = 60) -> list[str]:
    """Wrapped phrases joined: a line goes on if it is nearly full, or the next begins in lower
    case or after an open bracket; a line with a colon begins a field."""
    out: list[str] = []
    for line in (x.strip() for x in lines):
        if not line:
            continue
        if out and ":" not in line.split(" ")[0] and (len(out[-1]) >= width or line[:1].islower() or out[-1].count("(") > out[-1].count(")")):
            out[-1] = f"{out[-1]} {line}"
        else:
            out.append(line)
    return out


_NAME = re.compile(r"^(?P<botanical>[A-Z][a-z]+(?: (?:x )?[a-z-]+)?(?: (?:subsp|var|f)\. [a-z-]+)?(?: '[^']+')?)(?: *[-–(] *(?P<common>[^)]+?)\)?)?$")


def name_line(line: str) -> tuple[str | None, str | None]:
    """Botanical and common name of 'Genus epithet - Common name' or 'Common name (Genus epithet)'."""
    line = re.sub(r"\s+", " ", line.strip())
    if m := _NAME.match(line):
        return m["botanical"], m["common"]
    if (m := re.match(r"^(?P<common>.+?) *\((?P<b>[A-Z][a-z]+ [a-z-]+[^)]*)\)$", line)) and _NAME.match(m["b"]):
        return m["b"], m["common"]
    return None, line or None


def name_lines(df: DataFrame, column: str) -> DataFrame:
    """Adds botanical and common."""
    kind = T.StructType([*df.schema.fields, T.StructField("botanical", T.StringType()), T.StructField("common", T.StringType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            pairs = [name_line(x) if x is not None else (None, None) for x in p[column]]
            yield p.assign(botanical=[a for a, _ in pairs], common=[b for _, b in pairs])

    return df.mapInPandas(run, kind)
