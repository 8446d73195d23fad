"""Items seen before: lookups in the URL history by URL, title and domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.functions.urls import registered_domain
from newsflow.operators.skew import hot_keys, salted_join
from newsflow.session import cut_lineage


def _newest(history: DataFrame, keys: list[str], out: str) -> DataFrame:
    """History reduced to one row per key: the time it was last seen."""
    return history.groupBy(*keys).agg(F.max("created_at").alias(out))


def _is_new(seen_at: Column, found: Column, since: Column | None) -> Column:
    return ~found if since is None else ~found | F.coalesce(seen_at > since, F.lit(False))


def unseen_items(
    items: DataFrame, history: DataFrame, since: Column | None = None, hot_share: float = 0.01
) -> DataFrame:
    """Items that are new by URL, and otherwise by source and title.

    ``items`` has ``id``, ``url``, ``source``, ``title``; ``history`` has ``initial_url``,
    ``source``, ``title``, ``created_at``. With ``since`` an item last seen after that time
    counts as new. An item without a URL stays. The second lookup only counts for
    items whose URL is not in the history.

    One pass: rows that need no lookup get a key of their own, which spreads them evenly
    and matches nothing that is not ruled out again by their flag.
    """
    by_url = _newest(
        history.filter(F.col("initial_url") != "").withColumnRenamed("initial_url", "_ukey"), ["_ukey"], "_u_at"
    ).withColumn("_u", F.lit(True))
    by_title = _newest(history, ["source", "title"], "_t_at").select(
        F.xxhash64("source", "title").alias("_tkey"), "source", "title", "_t_at", F.lit(True).alias("_t"))
    blank = F.coalesce(F.col("url"), F.lit("")) == ""
    own = F.concat(F.lit("#"), F.col("id").cast("string"))
    rows = items.withColumn("_blank", blank).withColumn("_ukey", F.when(blank, own).otherwise(F.col("url")))
    first = salted_join(rows, by_url, "_ukey", "left", hot_keys(rows, "_ukey", hot_share), ["id"])
    found_url = ~F.col("_blank") & F.coalesce(F.col("_u"), F.lit(False))
    title_key = F.xxhash64("source", "title")
    keyed = first.withColumn("_found_url", found_url).withColumn(
        "_tkey", F.when(F.col("_blank") | found_url, F.xxhash64("id", F.lit("own"))).otherwise(title_key))
    hot = hot_keys(items.select(title_key.alias("_tkey")), "_tkey", hot_share)
    second = salted_join(keyed, by_title, "_tkey", "left", hot, ["id"], also=("source", "title"))
    found_title = ~F.col("_blank") & ~F.col("_found_url") & F.coalesce(F.col("_t"), F.lit(False))
    seen_at = F.when(F.col("_found_url"), F.col("_u_at")).when(found_title, F.col("_t_at"))
    judged = second.withColumn("_new", _is_new(seen_at, F.col("_found_url") | found_title, since))
    return judged.filter("_new").select(items.columns)


def unseen_after_redirect(
    items: DataFrame, history: DataFrame, since: Column | None = None, domain: Column | None = None,
    hot_share: float = 0.01,
) -> DataFrame:
    """Downloaded items that are new by final URL, and otherwise by title and domain.

    The second lookup matches history rows with the same title whose final or initial URL
    contains the item's registered domain; the newest match counts. Items without a final
    URL stay.
    """
    filled = F.coalesce(F.col("final_url"), F.lit("")) != ""
    by_final = _newest(
        history.filter(filled).select(F.col("final_url").alias("_fkey"), "created_at"), ["_fkey"], "_f_at"
    ).withColumn("_f", F.lit(True))
    own = F.concat(F.lit("#"), F.col("id").cast("string"))
    domain = registered_domain("final_url") if domain is None else domain
    rows = (
        items.withColumn("_filled", filled).withColumn("_fkey", F.when(filled, F.col("final_url")).otherwise(own))
        .withColumn("_domain", domain)
    )
    pair_key = F.xxhash64("title", "_domain")
    lookup = rows.filter(F.col("_filled") & (F.col("_domain") != "") & (F.coalesce(F.col("title"), F.lit("")) != ""))
    matches = _title_domain_matches(lookup.select("title", "_domain").distinct(), history).select(
        pair_key.alias("_pkey"), "title", "_domain", "_m_at", F.lit(True).alias("_m"))
    first = salted_join(rows, by_final, "_fkey", "left", hot_keys(rows, "_fkey", hot_share), ["id"])
    found_final = F.col("_filled") & F.coalesce(F.col("_f"), F.lit(False))
    keyed = first.withColumn("_found_final", found_final).withColumn(
        "_pkey", F.when(~F.col("_filled") | found_final, F.xxhash64("id", F.lit("own"))).otherwise(pair_key))
    hot = hot_keys(rows.select(pair_key.alias("_pkey")), "_pkey", hot_share)
    second = salted_join(keyed, matches, "_pkey", "left", hot, ["id"], also=("title", "_domain"))
    found_pair = F.col("_filled") & ~F.col("_found_final") & F.coalesce(F.col("_m"), F.lit(False))
    seen_at = F.when(F.col("_found_final"), F.col("_f_at")).when(found_pair, F.col("_m_at"))
    judged = second.withColumn("_new", _is_new(seen_at, F.col("_found_final") | found_pair, since))
    return judged.filter("_new").select(items.columns)


def _title_domain_matches(pairs: DataFrame, history: DataFrame) -> DataFrame:
    """Newest history time per distinct (title, domain) with equal title and containing URL.

    Items are reduced to distinct (title, domain) and history to the titles asked for. A
    frequent title would still meet domains x URLs, so both sides also join on the first
    characters of the domain, which a URL that contains the domain must contain as well; of a URL only
    pieces of the lengths asked for are made. The history is the streamed side: for one key a task holds the few domains
    asked for, never all URLs of a title.
    """
    pairs = cut_lineage(pairs)
    urls = F.concat_ws(
        "\n", F.lower(F.coalesce(F.col("final_url"), F.lit(""))), F.lower(F.coalesce(F.col("initial_url"), F.lit("")))
    )
    seen = (
        history.join(pairs.select("title").distinct(), "title", "left_semi")
        .select("title", urls.alias("_urls"), "created_at")
        .groupBy("title", "_urls").agg(F.max("created_at").alias("created_at"))
    )
    domain = F.lower("_domain")
    size = F.length(domain)
    gram = F.when(size >= 8, F.substring(domain, 1, 8)).when(size >= 4, F.substring(domain, 1, 4)).otherwise(domain)
    asked = pairs.withColumn("_gram", gram)
    lengths = sorted(r[0] for r in asked.select(F.length("_gram")).distinct().collect()) or [8]  # of 1, 2, 3, 4, 8
    starts = F.sequence(F.lit(1), F.length("_urls"))
    grams = F.flatten(F.array(*[F.transform(starts, lambda i: F.substr(F.col("_urls"), i, F.lit(n))) for n in lengths]))
    return (
        seen.withColumn("_gram", F.explode(F.array_distinct(grams))).join(asked, ["title", "_gram"])
        .filter(F.contains(F.col("_urls"), domain))
        .groupBy("title", "_domain")
        .agg(F.max("created_at").alias("_m_at"))
    )
