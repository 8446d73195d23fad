"""Array and JSON columns: topics, tags, keywords, token probabilities."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsflow.functions.text import strip


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    Inside a lambda an expression is computed again for every element; a lambda variable
    is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _empty() -> Column:
    return F.array().cast("array<string>")


def _clean(values: Column) -> Column:
    return F.filter(F.transform(values, strip), lambda x: x.isNotNull() & (x != ""))


def topics_to_text(topics) -> Column:
    """Comma-joined trimmed topics, NULL when nothing is left."""
    return F.nullif(F.array_join(_clean(_col(topics)), ","), F.lit(""))


def text_to_topics(text) -> Column:
    return F.coalesce(_clean(F.split(_col(text), ",")), _empty())


def keep_vocabulary(topics, vocabulary: Sequence[str]) -> Column:
    """Topics that are in the vocabulary, order and repeats kept; NULL becomes empty."""
    known = F.array(*[F.lit(v) for v in vocabulary])
    return F.coalesce(F.filter(_col(topics), lambda t: F.array_contains(known, t)), _empty())


def union_tags(*arrays) -> Column:
    """Distinct sorted union; NULL arrays count as empty."""
    merged = F.concat(*[F.coalesce(_col(a), _empty()) for a in arrays])
    return F.array_sort(F.array_distinct(merged))


def flat_tags(nested) -> Column:
    """Nested arrays flattened, trimmed, blanks dropped, distinct and sorted."""
    flat = F.flatten(F.filter(_col(nested), lambda x: x.isNotNull()))
    return F.coalesce(F.array_sort(F.array_distinct(_clean(flat))), _empty())


def split_keywords(text) -> Column:
    return F.transform(F.split(_col(text), ","), strip)


def json_ld_tags(scripts) -> Column:
    """Keywords and sections of an array of JSON-LD scripts.

    A script is one object or an array of objects; ``keywords`` is a list or a
    comma-separated text; text that is no JSON adds nothing.
    """

    def of_object(obj: Column) -> Column:
        keywords = F.get_json_object(obj, "$.keywords")
        listed = F.from_json(keywords, "array<string>")
        section = F.get_json_object(obj, "$.articleSection")
        sections = F.from_json(section, "array<string>")
        from_keywords = F.when(keywords.startswith("["), listed).otherwise(split_keywords(keywords))
        from_section = F.when(section.startswith("["), sections).otherwise(F.array(section))
        return F.concat(
            F.coalesce(from_keywords, _empty()),
            F.coalesce(F.filter(from_section, lambda x: x.isNotNull()), _empty()),
        )

    return F.flatten(F.transform(json_ld_objects(scripts), of_object))


def json_ld_objects(scripts) -> Column:
    """Every JSON-LD script as one text per object."""

    def objects(script: Column) -> Column:
        script = strip(script)
        return F.when(
            script.startswith("["), F.coalesce(F.from_json(script, "array<string>"), _empty())
        ).otherwise(F.array(script))

    return F.flatten(F.transform(F.coalesce(_col(scripts), _empty()), objects))


def token_probability(tops, token: str) -> Column:
    """Probability of the first listed token equal to ``token``, 0 when it is not listed."""
    hit = F.get(F.filter(_col(tops), lambda t: t["token"] == F.lit(token)), F.lit(0))
    return F.coalesce(F.exp(hit["logprob"]), F.lit(0.0))


def vocabulary_topics(text, vocabulary: Sequence[str]) -> Column:
    """Vocabulary entries that occur in the text, in vocabulary order."""
    lowered = F.lower(F.coalesce(_col(text), F.lit("")))
    known = F.array(*[F.lit(v) for v in vocabulary])
    return bind(lowered, lambda low: F.filter(known, lambda t: F.contains(low, F.lower(t))))
