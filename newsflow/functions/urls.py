"""URL columns: cleaning, parts, absolute form, registered domain, file names."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow.functions.arrays import bind

# Suffixes under which a name is registered, used when the caller
# supplies no suffix table of their own.
DEFAULT_SUFFIXES = (
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro",
    "io", "ai", "co", "me", "tv", "cc", "app", "dev", "tech", "news", "blog", "media",
    "us", "uk", "co.uk", "org.uk", "ac.uk", "gov.uk", "eu", "de", "fr", "es", "it", "nl",
    "be", "ch", "at", "se", "no", "dk", "fi", "pl", "pt", "ie", "ru", "ua", "jp", "co.jp",
    "cn", "com.cn", "hk", "com.hk", "tw", "com.tw", "kr", "co.kr", "in", "co.in", "sg",
    "com.sg", "au", "com.au", "org.au", "nz", "co.nz", "za", "co.za", "br", "com.br",
    "mx", "com.mx", "ca", "il", "co.il", "is", "example",
)

# Second-level labels that are suffixes under any two-letter one, listed or not.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
_ADDRESS = r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*|[0-9a-f]*:.*)$"

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clean_url(url: Column | str) -> Column:
    """Everything before the first ``?`` (a fragment in front of it stays)."""
    return F.substring_index(_col(url), "?", 1)


def authority(url: Column | str) -> Column:
    """Network location including user info and port, '' when there is none."""
    return F.regexp_extract(_col(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def host(url: Column | str) -> Column:
    """Lower-cased host without user info and port."""
    bare = F.regexp_replace(authority(url), r"^.*@", "")
    return F.lower(F.regexp_replace(bare, r":[0-9]*$", ""))


def path(url: Column | str) -> Column:
    return F.regexp_extract(
        _col(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1
    )


@F.pandas_udf(T.StringType())
def absolute_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """``href`` resolved against ``base``; Arrow-batched because dot segments need a loop."""

    def join(b, h):
        try:
            return urljoin(b or "", h or "")
        except ValueError:
            return None

    return pd.Series([join(b, h) for b, h in zip(base, href)], dtype="object")


def base_of(page_url: Column | str, base_href: Column | str) -> Column:
    """The page's base tag wins over its own address."""
    return F.coalesce(F.nullif(_col(base_href), F.lit("")), _col(page_url))


def has_path(url: Column | str) -> Column:
    return F.length(path(clean_url(url))) > 1


def is_http(url: Column | str) -> Column:
    return F.coalesce(_col(url).startswith("http"), F.lit(False))


def matches_all(url: Column | str, patterns: Sequence[str] | Column) -> Column:
    """Every pattern matches from the start of the text; no pattern keeps everything."""
    return _anchored(url, patterns, F.forall, lambda a, b: a & b, True)


def matches_any(url: Column | str, patterns: Sequence[str] | Column) -> Column:
    """At least one pattern matches from the start of the text."""
    return _anchored(url, patterns, F.exists, lambda a, b: a | b, False)


def _anchored(url, patterns, over_array, combine, empty):
    url = _col(url)
    if isinstance(patterns, Column):
        test = over_array(
            patterns, lambda p: F.coalesce(F.rlike(url, F.concat(F.lit("^(?:"), p, F.lit(")"))), F.lit(False))
        )
        return F.coalesce(test, F.lit(empty))
    result = F.lit(empty)
    for pattern in patterns:
        result = combine(result, F.coalesce(url.rlike(f"^(?:{pattern})"), F.lit(False)))
    return result


def not_blocked(url: Column | str, hosts: Sequence[str]) -> Column:
    """The network location is none of ``hosts`` (exact match)."""
    return ~authority(url).isin(*hosts) if hosts else F.lit(True)


def registered_domain(url: Column | str, suffixes: Sequence[str] = DEFAULT_SUFFIXES) -> Column:
    """Registered domain of a URL or bare host, '' for null or an empty host.

    The longest suffix decides: listed ones, a general second-level label before two letters
    (``gov.br``), else the last label of a host with several. A host that is nothing but a suffix
    yields '', a single label that is none yields itself, and a numeric address is its own domain.
    Suffix lists too long for a literal go through :func:`with_registered_domain`.
    """
    name = _bare_host(url)
    labels = F.split(name, r"\.")
    known = F.array(*[F.lit(s) for s in suffixes])
    tails = bind(labels, lambda parts: F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    listed = lambda t: F.array_contains(known, t) | t.rlike(_GENERAL)
    cut = F.array_position(F.transform(tails, listed), True)
    return (
        F.when(name == "", "")
        .when(name.rlike(_ADDRESS), name)
        .when(cut > 1, F.get(tails, (cut - 2).cast("int")))
        .when(cut == 1, "")
        .otherwise(F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2), "."))
    )


_GENERAL = rf"^(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}$"


def _bare_host(url: Column | str) -> Column:
    url = F.coalesce(_col(url), F.lit(""))
    return F.when(url.contains("//"), host(url)).otherwise(
        F.lower(F.regexp_replace(F.regexp_extract(url, r"^([^/?#]*)", 1), r":[0-9]*$", ""))
    )


def with_registered_domain(df: DataFrame, url: str, suffixes: DataFrame, out: str = "domain") -> DataFrame:
    """As :func:`registered_domain` with the suffixes in a one-column table ``suffix``.

    Works on distinct hosts, so the label tails are exploded once per host and not once
    per row; Spark itself decides whether the suffix table is small enough to broadcast.
    """
    named = df.withColumn("_host", _bare_host(url))
    labels = F.split("_host", r"\.")
    tails = (
        named.select("_host").distinct()
        .select("_host", F.posexplode(F.transform(
            F.sequence(F.lit(1), F.size(labels)),
            lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("_p", "_tail"))
    )
    listed = tails.join(suffixes.select(F.col("suffix").alias("_tail")).distinct(), "_tail", "left_semi").select("_host", "_p")
    general = tails.filter(F.col("_tail").rlike(_GENERAL)).select("_host", "_p")
    found = listed.unionByName(general).groupBy("_host").agg(F.min("_p").alias("_cut"))
    parts = F.split("_host", r"\.")
    domain = (
        F.when(F.col("_host") == "", "")
        .when(F.col("_host").rlike(_ADDRESS), F.col("_host"))
        .when(F.col("_cut") == 0, "")
        .when(F.col("_cut").isNotNull(),
              F.array_join(F.slice(parts, F.col("_cut"), F.size(parts)), "."))
        .otherwise(F.array_join(F.slice(parts, -F.least(F.size(parts), F.lit(2)), 2), "."))
    )
    return named.join(found, "_host", "left").withColumn(out, domain).drop("_host", "_cut")


def safe_filename(title: Column | str, limit: int = 249) -> Column:
    """A title made usable as a file name."""
    step = F.regexp_replace(_col(title), r'[<>:"/\\|?*]', "_")
    step = F.regexp_replace(step, r"[^\p{L}\p{N}_\-.]", "_")
    return F.substring(F.regexp_replace(step, r"^_+|_+$", ""), 1, limit)


def http_status_ok(status: Column | str) -> Column:
    return F.coalesce(_col(status).between(200, 399), F.lit(False))


# Names of the failures that are reported one by one.
STATUS_NAMES = {
    400: "bad request error",
    401: "unauthorized error",
    403: "forbidden error",
    404: "not found error",
    429: "rate limited error",
    500: "internal server error",
    502: "bad gateway error",
    503: "service unavailable error",
    504: "gateway timeout error",
}


def http_status_text(status: Column | str) -> Column:
    status = _col(status)
    names = F.create_map(*[F.lit(x) for pair in STATUS_NAMES.items() for x in pair])
    by_range = (
        F.when(status.between(400, 499), "client error")
        .when(status.between(500, 599), "server error")
        .otherwise("unknown error")
    )
    text = F.concat_ws(" ", F.coalesce(F.try_element_at(names, status.cast("int")), by_range), status.cast("string"))
    return F.when(status.isNull(), "no response received").otherwise(text)
