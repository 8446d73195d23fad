"""Text columns: clean-up, summaries, model input, links, redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a secret, applied in this order, ignoring case, and the
# text that takes its place.
SECRET_PATTERNS = (
    r"sk-[a-zA-Z0-9]{20,}",
    r"sk-proj-[a-zA-Z0-9]{25,}",
    r"sk-ant-[a-zA-Z0-9-]{40,}",
    r"AIza[a-zA-Z0-9_-]{35}",
    r"gsk_[a-zA-Z0-9]{40,}",
    r"ya29\.[a-zA-Z0-9_-]+",
    r"AKIA[0-9A-Z]{16}",
    r"aws_access_key_id=[A-Z0-9]+",
    r"""api[_-]?key\s*[=:]\s*["\']?[a-zA-Z0-9_-]{8,}["\']?""",
    r"authorization\s*:\s*[^\s,]+",
    r"bearer\s+[a-zA-Z0-9_.-]+",
    r"""token\s*[=:]\s*["\']?[a-zA-Z0-9_.-]{8,}["\']?""",
    r"""secret\s*[=:]\s*["\']?[a-zA-Z0-9_.-]{8,}["\']?""",
    r"""password\s*[=:]\s*["\']?[a-zA-Z0-9_.-]{8,}["\']?""",
    r'"(?:api_key|token|secret|password)"\s*:\s*"[^"]+',
    r"[?&](?:api_key|token|secret|password)=[^&\s]+",
    r"ghp_[a-zA-Z0-9]{36}",
    r"gho_[a-zA-Z0-9]{36}",
    r"xox[bpoa]-[0-9]+-[0-9]+-[a-zA-Z0-9]+",
)
REDACTED = "[API_KEY_REDACTED]"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def blank_to_null(value: Column | str) -> Column:
    trimmed = strip(value)
    return F.when(trimmed != "", trimmed)


def strip(value: Column | str) -> Column:
    """White space of every kind removed at both ends (``trim`` only knows blanks)."""
    return F.regexp_replace(_col(value), r"^\s+|\s+$", "")


def redact_secrets(text: Column | str) -> Column:
    """Keys, tokens and passwords replaced, pattern after pattern."""
    return reduce(
        lambda t, p: F.regexp_replace(t, f"(?i){p}", REDACTED), SECRET_PATTERNS, _col(text)
    )


def truncate_tokens(text: Column | str, limit: int = 8192) -> Column:
    """The first ``limit`` words; texts within the limit keep their white space."""
    text = _col(text)
    words = F.split(strip(text), r"\s+")
    return F.when(F.size(words) > limit, F.array_join(F.slice(words, 1, limit), " ")).otherwise(text)


def drop_special_tokens(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"<\|\w+\|>", "")


def drop_urls(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"https?://\S+|www\.\S+", "")


def drop_cut_word(text: Column | str) -> Column:
    """Remove a last word that was cut off and ends in three dots."""
    return F.regexp_replace(_col(text), r"\s+\S+\.{3}$", "")


def strip_tags(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"<[^>]*>", "")


def word_count(text: Column | str) -> Column:
    bare = strip(text)
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"\s+")))


def preview(text: Column | str, limit: int = 500) -> Column:
    return F.substring(_col(text), 1, limit)


def first_line(text: Column | str) -> Column:
    """First non-blank line without surrounding asterisks; the whole text if there is none."""
    text = _col(text)
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    return F.regexp_replace(F.coalesce(F.get(lines, F.lit(0)), strip(text)), r"^\*+|\*+$", "")


def extended_summary(title, description, topics, summary) -> Column:
    """Non-blank parts joined by an empty line; topics are one comma-joined part."""
    joined = F.array_join(F.coalesce(_col(topics), F.array().cast("array<string>")), ", ")
    return F.concat_ws(
        "\n\n", blank_to_null(title), blank_to_null(description), blank_to_null(joined), blank_to_null(summary)
    )


def short_summary(short, topics) -> Column:
    """Short summary followed by the topics; '' without a short summary."""
    short = strip(F.coalesce(_col(short), F.lit("")))
    joined = F.array_join(F.coalesce(_col(topics), F.array().cast("array<string>")), ", ")
    tail = F.when(joined != "", F.concat(F.lit(" Topics: "), joined)).otherwise("")
    return F.when(F.length(short) > 0, F.concat(short, tail)).otherwise("")


def model_input(title, rss_summary, description, summary) -> Column:
    """Title, then feed summary or else description (without tags), then summary."""
    lead = F.coalesce(blank_to_null(strip_tags(rss_summary)), blank_to_null(strip_tags(description)))
    return F.concat_ws("\n", blank_to_null(title), lead, blank_to_null(summary))


def cluster_input(title, rss_summary, description, summary) -> Column:
    return F.concat_ws("\n", *[blank_to_null(c) for c in (title, rss_summary, description, summary)])


def bullet(title, summary) -> Column:
    blank = F.lit("")
    return F.concat(
        F.lit("• "), F.coalesce(_col(title), blank), F.lit(": "), F.coalesce(_col(summary), blank)
    )


def markdown_links(text: Column | str) -> Column:
    """``array<struct<name, url>>`` of the markdown links in a text."""
    pattern = F.lit(r"\[([^\]]+)\]\(([^)]+)\)")
    names = F.regexp_extract_all(_col(text), pattern, F.lit(1))
    urls = F.regexp_extract_all(_col(text), pattern, F.lit(2))
    return F.arrays_zip(names.alias("name"), urls.alias("url"))


def links_to_markdown(links: Column | str) -> Column:
    """``array<struct<url, site_name>>`` as markdown."""
    return F.array_join(
        F.transform(_col(links), lambda x: F.concat(F.lit("["), x["site_name"], F.lit("]("), x["url"], F.lit(")"))),
        " ",
    )


def site_display_name(name, domain) -> Column:
    return F.coalesce(blank_to_null(name), _col(domain))


def or_other(category, other: str = "Other") -> Column:
    """Blank, missing and literal ``None`` categories become ``Other``."""
    category = _col(category)
    bad = category.isNull() | (strip(category) == "") | (category == "None")
    return F.when(bad, other).otherwise(category)
