"""Results as JSON and CSV."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import Found, Result


def to_json(result: Result, indent: int = 4) -> str:
    """The best, the statistics and the gap as nested JSON."""
    return json.dumps({"subgroups": [{"pattern": f.text, "indices": list(f.indices), "score": f.score, "bound": f.bound, "n": f.n} for f in result.best], "statistics": result.stats, "gap": result.gap}, indent=indent)


def from_json(text: str) -> Result:
    """The best, the statistics and whether a search was exhausted, back from ``to_json``; what it left open is not in there."""
    whole = json.loads(text)
    best = [Found(tuple(r["indices"]), r["score"], r["bound"], r["n"], r["pattern"]) for r in whole["subgroups"]]
    top = best[0].score if best else 0.0
    return Result(best, whole["statistics"], whole["gap"] == 0, top * (1 + whole["gap"]) if top else whole["gap"])


def json_column(df: DataFrame, name: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias(name))


def renamed(df: DataFrame, rules: dict[str, str], regex: bool = True) -> DataFrame:
    """Columns renamed by patterns (or literally), in the order given."""
    out = []
    for c in df.columns:
        for pattern, new in rules.items():
            c = re.sub(pattern, new, c) if regex else (new if c == pattern else c)
        out.append(c)
    return df.toDF(*out)


def write_csv(df: DataFrame, path: str, sep: str = ",", digits: int | None = None, header: bool = True, mode: str = "error") -> None:
    """A CSV folder; floating columns with ``digits`` places, if given."""
    if digits is not None:
        df = df.select(*(F.format_string(f"%.{digits}f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
    df.write.mode(mode).csv(path, sep=sep, header=header)
