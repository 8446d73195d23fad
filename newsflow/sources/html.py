"""Links, metadata and text of raw HTML pages, as expressions over a ``pages`` table.

Everything but entity decoding and URL resolution runs as regular expressions inside the
JVM. That is a tag scanner, not a full parser: a ``>`` inside an attribute value ends the
tag, and boilerplate removal is by element name only.
"""

from __future__ import annotations

import html
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow.functions import arrays, scores, text, urls

# Elements without article text, and elements that end a line.
DROPPED = ("script", "style", "noscript", "svg", "iframe", "form", "nav", "header", "footer", "aside")
BLOCKS = "p|div|br|li|ul|ol|h[1-6]|tr|table|blockquote|pre|section|article|main|dd|dt|figcaption"

# Where a page states its time, in order of preference.
TIME_META = (
    ("property", "article:published_time"),
    ("property", "og:published_time"),
    ("property", "article:modified_time"),
    ("property", "og:updated_time"),
    ("name", "pubdate"),
    ("name", "publish_date"),
    ("name", "Last-Modified"),
    ("name", "lastmod"),
)


# Inside of a tag: quoted values may hold a ">"; where quotes are not in pairs, up to the next ">".
ATTRIBUTES = r"""(?:[^'">]*+(?:(?:"[^"]*+"|'[^']*+')[^'">]*+)*+(?=>)|[^>]*)"""


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


@F.pandas_udf(T.StringType())
def decode_entities(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def _drop_element(page: Column, name: str) -> Column:
    return F.regexp_replace(page, rf"(?is)<{name}(?:\s{ATTRIBUTES})?>.*?</{name}\s*>", " ")


def without_comments(page: Column | str) -> Column:
    return F.regexp_replace(_col(page), r"(?s)<!--.*?-->", " ")


def markup(page: Column | str) -> Column:
    """The page without comments, scripts and styles."""
    out = without_comments(page)
    for name in ("script", "style"):
        out = _drop_element(out, name)
    return out


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in the text between the tag name and ``>``, '' if absent."""
    pattern = rf"""(?is)(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])


def _tags(page: Column, name: str) -> Column:
    """Attribute texts of all tags of one name."""
    return F.regexp_extract_all(page, F.lit(rf"(?is)<{name}((?:\s{ATTRIBUTES})?)>"), F.lit(1))


def page_title(page: Column) -> Column:
    return text.strip(F.regexp_extract(page, r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", 1))


def page_facts(pages: DataFrame, page: str = "html", url: str = "url") -> DataFrame:
    """Pages with ``metas``, ``page_title``, ``canonical``, ``base_href`` and ``json_ld``.

    The later functions read these columns, so the page text is scanned once.
    """
    bare = markup(page)
    metas = F.transform(
        _tags(F.col("_markup"), "meta"),
        lambda t: F.struct(
            attribute(t, "property").alias("property"), attribute(t, "name").alias("name"),
            attribute(t, "content").alias("content"),
        ),
    )
    canonical = F.filter(_tags(F.col("_markup"), "link"), lambda t: F.lower(attribute(t, "rel")) == "canonical")
    scripts = F.regexp_extract_all(
        without_comments(page),
        F.lit(r"""(?is)<script\s[^>]*application/ld\+json[^>]*>(.*?)</script\s*>"""), F.lit(1),
    )
    return (
        pages.withColumn("_markup", bare)
        .withColumn("metas", metas)
        .withColumn("page_title", page_title(F.col("_markup")))
        .withColumn("canonical", F.coalesce(attribute(F.get(canonical, F.lit(0)), "href"), F.lit("")))
        .withColumn("base_href", F.coalesce(attribute(F.get(_tags(F.col("_markup"), "base"), F.lit(0)), "href"), F.lit("")))
        .withColumn("json_ld", scripts)
    )


def meta(kind: str, name: str) -> Column:
    """Content of the first meta tag with this property or name, '' if there is none."""
    hit = F.get(F.filter(F.col("metas"), lambda m: m[kind] == name), F.lit(0))
    return F.coalesce(hit["content"], F.lit(""))


def og_tags() -> Column:
    """Map of the ``og:`` properties and the page title; the last of equal keys counts."""
    wanted = F.filter(F.col("metas"), lambda m: m["property"].startswith("og:"))
    pairs = F.reverse(F.transform(wanted, lambda m: F.struct(m["property"].alias("key"), m["content"].alias("value"))))
    keys = F.transform(pairs, lambda p: p["key"])
    last = F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1)
    title = F.when(
        F.col("page_title") != "",
        F.array(F.struct(F.lit("title").alias("key"), F.col("page_title").alias("value"))),
    ).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    return F.map_from_entries(F.concat(last, title))


def description() -> Column:
    """Open Graph, then Twitter, then plain description; the first that is not blank."""
    return F.coalesce(
        *[text.blank_to_null(meta(kind, name)) for kind, name in
          (("property", "og:description"), ("name", "twitter:description"), ("name", "description"))],
        F.lit(""),
    )


def tags() -> Column:
    """Distinct sorted tags from article tags, sections, keywords and JSON-LD."""
    article = F.transform(F.filter(F.col("metas"), lambda m: m["property"] == "article:tag"), lambda m: m["content"])
    single = F.array(meta("property", "article:section"), meta("name", "parsely-section"))
    keywords = arrays.split_keywords(meta("name", "keywords"))
    return arrays.flat_tags(F.array(article, single, keywords, arrays.json_ld_tags(F.col("json_ld"))))


def last_updated(now: Column, header: Column | None = None) -> Column:
    """Time of the page in UTC: JSON-LD article date, else meta tags, else the HTTP header."""
    stated = F.coalesce(*[F.nullif(meta(kind, name), F.lit("")) for kind, name in TIME_META])
    objects = F.filter(F.col("json_ld"), lambda s: F.get_json_object(s, "$['@type']") == "NewsArticle")
    article = F.get(objects, F.lit(0))
    dated = F.get_json_object(article, "$.datePublished")
    found = F.when(article.isNotNull(), dated).otherwise(stated)
    if header is not None:
        found = F.coalesce(F.nullif(found, F.lit("")), header)
    return scores.zulu(scores.parse_time(found, now))


def final_url(url: Column | str) -> Column:
    return F.coalesce(F.nullif(F.col("canonical"), F.lit("")), _col(url))


def body_text(page: Column | str) -> Column:
    """Visible text of the article (or of the page without navigation), one line per block."""
    out = without_comments(page)
    for name in DROPPED:
        out = _drop_element(out, name)
    out = F.regexp_replace(out, r"(?is)<head(?:\s[^>]*)?>.*?</head\s*>", " ")
    article = F.regexp_extract(out, rf"(?is)<article(?:\s{ATTRIBUTES})?>(.*)</article\s*>", 1)
    out = F.when(article != "", article).otherwise(out)
    out = F.regexp_replace(out, rf"(?i)</?(?:{BLOCKS})(?:\s{ATTRIBUTES})?/?>", "\n")
    out = decode_entities(F.regexp_replace(out, rf"<{ATTRIBUTES}>", ""))
    out = F.regexp_replace(out, r"[ \t\r\f]+", " ")
    out = F.regexp_replace(out, r" ?\n[ \n]*", "\n")
    return text.strip(out)


def page_text(page: Column | str, max_tokens: int | None = 8192) -> Column:
    """Title, social card title and description, then the body; over ``page_facts`` rows. ``max_tokens`` None: all of it."""
    def labelled(label: str, value: Column) -> Column:
        value = text.strip(decode_entities(value))
        return F.when(value != "", F.concat(F.lit(label), value, F.lit("\n"))).otherwise("")

    def card(name: str) -> Column:
        og = meta("property", f"og:{name}")
        has_og = F.exists(F.col("metas"), lambda m: m["property"] == f"og:{name}")
        return F.when(has_og, og).otherwise(meta("name", f"twitter:{name}"))

    full = F.concat(
        labelled("Page title: ", F.col("page_title")),
        labelled("Social card title: ", card("title")),
        labelled("Social card description: ", card("description")),
        text.drop_special_tokens(body_text(page)),
    )
    return F.coalesce(full if max_tokens is None else text.truncate_tokens(full, max_tokens), F.lit(""))


def raw_links(pages: DataFrame, page: str = "html") -> DataFrame:
    """Every ``<a>`` of every page: ``(page_id, source, url, ord, href, title, base_href)``."""
    pattern = F.lit(rf"(?is)<a((?:\s{ATTRIBUTES})?)>(.*?)</a\s*>")
    facts = pages.withColumn("_markup", markup(page))
    base = F.coalesce(attribute(F.get(_tags(F.col("_markup"), "base"), F.lit(0)), "href"), F.lit(""))
    found = F.arrays_zip(
        F.regexp_extract_all("_markup", pattern, F.lit(1)).alias("tag"),
        F.regexp_extract_all("_markup", pattern, F.lit(2)).alias("inner"),
    )
    source = F.col("source") if "source" in pages.columns else urls.authority("url")
    rows = facts.select(
        "page_id", source.alias("source"), F.col("url").alias("page_url"), base.alias("base_href"),
        F.posexplode(found).alias("ord", "a"),
    )
    # Text pieces are trimmed one by one, so white space next to a tag goes with the tag.
    title = text.strip(decode_entities(F.regexp_replace("a.inner", rf"\s*<{ATTRIBUTES}>\s*", "")))
    return rows.select(
        "page_id", "source", "page_url", "base_href", "ord",
        decode_entities(attribute(F.col("a.tag"), "href")).alias("href"), title.alias("title"),
    )


def page_links(
    pages: DataFrame, min_length: int = 28, include: Sequence[str] = (), exclude: Sequence[str] = (),
    blocked: Sequence[str] = (), titles: DataFrame | None = None,
) -> DataFrame:
    """Headline links of landing pages as ``(page_id, ord, title, url, src)``.

    Kept are links with a text that is not a number and longer than ``min_length``, an http
    address with a path, all ``include`` patterns and none of the ``exclude`` patterns. A
    link named ``LINK`` takes the title that ``titles`` (url, og_title) holds for its target.
    """
    links = raw_links(pages).filter((F.col("title") != "") & ~F.col("title").rlike(r"^\d+$"))
    links = links.withColumn("_abs", urls.absolute_url(urls.base_of("page_url", "base_href"), F.col("href")))
    links = links.filter(urls.has_path("_abs") & urls.is_http("_abs"))
    links = links.filter(~urls.matches_any("_abs", exclude) & urls.matches_all("_abs", include))
    if blocked:
        links = links.filter(urls.not_blocked("_abs", blocked))
    out = links.select("page_id", "ord", "title", urls.clean_url("_abs").alias("url"), F.col("source").alias("src"))
    if titles is not None:
        known = titles.select("url", F.nullif("og_title", F.lit("")).alias("_og"))
        better = F.when(F.col("title") == "LINK", F.coalesce("_og", "title")).otherwise(F.col("title"))
        out = out.join(known, "url", "left").withColumn("title", better).drop("_og")
    return out.filter((F.length("title") > min_length) | (F.col("title") == "LINK"))


def page_stats(df: DataFrame, key: str, body: str) -> DataFrame:
    """Characters, words and a 500-character preview per page."""
    return df.select(
        key, F.coalesce(F.length(body), F.lit(0)).alias("chars"), text.word_count(body).alias("words"),
        text.preview(body, 500).alias("preview"),
    )
