"""Source catalogue: checks of its entries."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = ("rss", "html", "rest")


@F.pandas_udf(T.BooleanType())
def _compiles(patterns: pd.Series) -> pd.Series:
    def good(pattern):
        try:
            re.compile(pattern)
            return True
        except (re.error, TypeError):
            return False

    return patterns.map(good).astype(bool)


def check_catalog(catalog: DataFrame) -> DataFrame:
    """``(name, level, issue)``: errors and warnings of a source catalogue, none if it is fine.

    A missing or unknown type hides further errors of that source.
    """
    def blank(name: str):
        return F.coalesce(F.col(name), F.lit("")) == ""

    kind = F.col("type")
    known = ~blank("type") & kind.isin(*TYPES)

    def issue(level: str, text):
        text = F.lit(text) if isinstance(text, str) else text
        return F.struct(F.lit(level).alias("level"), text.alias("issue"))

    rules = [
        F.when(blank("type"), issue("ERROR", "missing type")),
        F.when(~blank("type") & ~kind.isin(*TYPES), issue("ERROR", F.concat(F.lit("invalid type "), kind))),
        F.when((kind == "rss") & blank("rss") & blank("url"), issue("ERROR", "rss source needs rss or url")),
        F.when((kind == "html") & blank("url"), issue("ERROR", "html source needs url")),
        F.when((kind == "rest") & blank("function_name"), issue("ERROR", "rest source needs function_name")),
    ] + [
        F.when(known & F.col(field).isNotNull() & (F.col(field) <= 0),
               issue("WARNING", f"{field} should be positive"))
        for field in ("scroll", "initial_sleep", "minlength")
    ]
    found = catalog.select("name", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("i"))
    out = found.select("name", "i.level", "i.issue")
    for field in ("include", "exclude"):
        patterns = catalog.filter(known).select("name", F.explode(field).alias("_p"))
        broken = patterns.filter(~_compiles("_p"))
        out = out.unionByName(
            broken.select("name", F.lit("ERROR").alias("level"), F.concat(F.lit(f"invalid regex in {field}: "), "_p").alias("issue"))
        )
    return out
