"""Queries over aggregations, rankings, de-duplication and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsflow.functions import scores
from newsflow.operators import dedup, edits, evaluate, neardup, numbering, stats
from newsflow.plans.registry import ITEMS, items, now, query, table, texts

_RATED = f"""
    (select id, lang as cat, source as section_title, n_chars, least(greatest(log10(greatest(n_chars, 1)) - 3, 0), 2)
       + 2 * exp(-ln(2) * (age_h / 24.0)) - 1 + id % 4 as rating from {ITEMS})"""


def _rated(spark, d):
    df = items(spark, d)
    rating = scores.length_score("n_chars") + scores.recency_score(F.col("age_h") / 24.0) + F.col("id") % 4
    return df.select("id", F.col("lang").alias("cat"), F.col("source").alias("section_title"), "n_chars", rating.alias("rating"))


@query("rated_sections", f"""
    with best as (select * from {ITEMS} qualify row_number() over (partition by text order by n_chars desc, id) = 1),
    rated as (select source as cat, lang as section_title, id % 3 + least(greatest(log10(greatest(n_chars, 1)) - 3, 0), 2) + 1 + 1
                + 2 * exp(-ln(2) * (age_h / 24.0)) - 1 as rating from best where age_h / 24.0 < 7),
    s as (select cat, section_title, avg(rating) as rating, count(*) as count from rated group by 1, 2)
    select cat, section_title, round(rating, 6) as rating, count, round(rating * ln(1 + count), 6) as score,
      row_number() over (order by rating * ln(1 + count) desc, cat, section_title) - 1 as sort_order from s""")
def rated_sections(spark, d):
    """Best copy per text, rated by age and length within a week, sections in order."""
    best = dedup.first_per_text(items(spark, d), "text", [F.desc("n_chars"), "id"])
    stamp = now() - F.make_dt_interval(F.lit(0), F.col("age_h").cast("int"))
    aged = best.withColumn("age", scores.age_days(stamp, now())).filter(F.col("age") < 7)
    missing = F.lit(None).cast("double")
    rating = scores.composite_rating(
        F.col("id") % 3, scores.length_score("n_chars"), missing, missing, missing, missing, scores.recency_score("age"))
    rated = aged.select("id", F.col("source").alias("cat"), F.col("lang").alias("section_title"), rating.alias("rating"))
    out = edits.section_order(rated)
    return out.withColumn("rating", F.round("rating", 6)).withColumn("score", F.round("score", 6))


# ------------------------------------------------------------------ one row per key


@query("dedup_exact_best", "select doc_id, source, n_chars from documents qualify row_number() over (partition by text order by n_chars desc, doc_id) = 1")
def dedup_exact_best(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars", "text")
    return dedup.first_per_text(docs, "text", [F.desc("n_chars"), "doc_id"]).drop("text")


@query("dedup_first_key", """
    select page_id, split_part(split_part(url, '://', 2), '/', 1) as host from pages
    qualify row_number() over (partition by split_part(split_part(url, '://', 2), '/', 1) order by page_id) = 1""")
def dedup_first_key(spark, d):
    host = F.substring_index(F.element_at(F.split("url", "://"), 2), "/", 1)
    return dedup.first_per_key(table(spark, d, "pages").select("page_id", host.alias("host")), ["host"], ["page_id"])


@query("dedup_keep_last", "select o_custkey, max(o_orderkey) as o_orderkey, max_by(o_totalprice, o_orderkey) as o_totalprice from orders group by 1")
def dedup_keep_last(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return dedup.first_per_key(orders, ["o_custkey"], [F.desc("o_orderkey")])


@query("cap_per_source", "select doc_id, source from documents qualify row_number() over (partition by source order by doc_id) <= 30")
def cap_per_source(spark, d):
    return dedup.top_per_key(table(spark, d, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 30)


@query("concat_first_wins", """
    select c_custkey, 'large' as tier from customer where c_acctbal > 9000
    union all select c_custkey, 'building' from customer where c_mktsegment = 'BUILDING' and c_acctbal <= 9000""")
def concat_first_wins(spark, d):
    customers = table(spark, d, "customer")
    large = customers.filter("c_acctbal > 9000").select("c_custkey", F.lit("large").alias("tier"))
    building = customers.filter("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit("building").alias("tier"))
    return dedup.concat_first_wins([large, building], "c_custkey")


@query("replace_group", """
    select doc_id, lang, 'old' as version from documents where lang <> 'fr'
    union all select doc_id, lang, 'new' from documents where lang = 'fr' and n_chars > 300""")
def replace_group(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    new = docs.filter("lang = 'fr' and n_chars > 300").select("doc_id", "lang", F.lit("new").alias("version"))
    return dedup.replace_group(docs.select("doc_id", "lang", F.lit("old").alias("version")), new, "lang")


@query("category_union", "select source as cat from documents union select lang from documents union select event_type from events")
def category_union(spark, d):
    docs = table(spark, d, "documents")
    names = docs.select(F.col("source").alias("cat")).unionByName(docs.select(F.col("lang").alias("cat")))
    return names.unionByName(table(spark, d, "events").select(F.col("event_type").alias("cat"))).distinct()


@query("dupe_boost", f"""
    select min(id) as id, cat, round(min_by(rating, id) + count(*) - 1, 6) as rating from
      (select r.*, text from {_RATED} r join documents on doc_id = id) group by cat, text""")
def dupe_boost(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    rated = _rated(spark, d).select("id", "cat", "rating").join(texts, "id")
    folded = neardup.fold_copies(rated, ["cat", "text"], "id", "rating")
    return folded.select("id", "cat", F.round("rating", 6).alias("rating"))


@query("dupe_marks", """
    with m as (select o_orderkey as id, o_totalprice as rating, case when o_orderkey % 3 = 0 and o_orderkey > 0 then o_orderkey // 9 else -1 end as dupe_id from orders)
    select id, round(rating + coalesce(n, 0), 6) as rating from m left join (select dupe_id as id, count(*) as n from m where dupe_id >= 0 group by 1) using (id)
    where dupe_id < 0""")
def dupe_marks(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("rating"))
    mark = F.when((F.col("id") % 3 == 0) & (F.col("id") > 0), F.floor(F.col("id") / 9)).otherwise(F.lit(-1))
    marks = orders.select("id", mark.cast("long").alias("dupe_id"))
    return neardup.boost_and_drop(orders, marks).select("id", F.round("rating", 6).alias("rating"))


# ------------------------------------------------------------------ numbers and ranks


@query("dense_numbering", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, row_number() over (order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey, l_suppkey) as rank from lineitem")
def dense_numbering(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return numbering.number_rows(lines, [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "rank")


@query("numbering_in_groups", "select event_id, event_type, row_number() over (partition by event_type order by value desc, event_id) as rank from events")
def numbering_in_groups(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", "value")
    return numbering.number_within(events, ["event_type"], [F.desc("value"), "event_id"], "rank").drop("value")


@query("chunks", "select doc_id, cast((row_number() over (order by doc_id) - 1) // 25 as bigint) as chunk from documents")
def chunks(spark, d):
    return numbering.chunk_rows(table(spark, d, "documents").select("doc_id"), ["doc_id"], 25)


@query("rank_change", """
    select cast(sum(abs(a - b)) as bigint) as total_change, round(avg(abs(a - b)), 6) as mean_change from
      (select row_number() over (order by o_totalprice desc, o_orderkey) as a, row_number() over (order by o_orderdate desc, o_orderkey) as b from orders)""")
def rank_change(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    by_price = numbering.number_rows(orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], "rank")
    by_date = numbering.number_rows(orders.select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), "o_orderkey"], "rank")
    return numbering.rank_change(by_date, by_price, "o_orderkey", "rank").withColumn("mean_change", F.round("mean_change", 6))


@query("positional_seed", "select doc_id, round(1 - (row_number() over (order by n_chars desc, doc_id) - 1) / (count(*) over () - 1), 6) as seed from documents")
def positional_seed(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    n = docs.select(F.count(F.lit(1))).scalar()
    ranked = numbering.number_rows(docs, [F.desc("n_chars"), "doc_id"], "rank")
    return ranked.select("doc_id", F.round(numbering.positional_seed("rank", n), 6).alias("seed"))


@query("moving_changes", """
    with r as (select cast(ts as date) as day, avg(value) as change from events group by 1),
    m as (select day, (change + coalesce(lag(change) over (order by day), change)) / 2 as last_two from r)
    select strftime(day, '%Y-%m-%d') as day, round(last_two, 6) as last_two, round(lag(last_two, 2) over (order by day), 6) as prev_two from m""")
def moving_changes(spark, d):
    """Daily means in the place of the rounds of a tournament."""
    rounds = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("change"))
    out = stats.moving_changes(rounds, "day", "change")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("last_two", 6).alias("last_two"), F.round("prev_two", 6).alias("prev_two"))


@query("zscore_minmax", """
    with s as (select avg(n_chars) as m, stddev_pop(n_chars) as sd, min(n_chars) as lo, max(n_chars) as hi from documents)
    select doc_id, round((n_chars - m) / sd, 6) as z, round((n_chars - lo) / (hi - lo), 6) as scaled from documents, s""")
def zscore_minmax(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    out = stats.add_minmax(stats.add_zscore(docs, "n_chars", "z"), "n_chars", "scaled")
    return out.select("doc_id", F.round("z", 6).alias("z"), F.round("scaled", 6).alias("scaled"))


@query("section_starts", f"""
    select id, cat, sort_order, row_number() over (partition by sort_order order by n_chars desc, id) as pos,
      lag(cat) over (order by sort_order, n_chars desc, id) is distinct from cat as new_section
    from {_RATED} join (select lang as cat, row_number() over (order by count(*) desc, lang) - 1 as sort_order from documents group by 1) using (cat)""")
def section_starts(spark, d):
    rated = _rated(spark, d).select("id", "cat", "n_chars")
    counts = rated.groupBy("cat").agg(F.count(F.lit(1)).alias("n"))
    order = numbering.number_rows(counts, [F.desc("n"), "cat"], "_n").select("cat", (F.col("_n") - 1).alias("sort_order"))
    return edits.mark_section_starts(rated.join(order, "cat"), [F.desc("n_chars"), "id"]).drop("n_chars")


@query("top_rated", f"select id, cat, round(rating, 6) as rating from {_RATED} order by rating desc, id limit 100")
def top_rated(spark, d):
    best = _rated(spark, d).orderBy(F.desc("rating"), "id").limit(100)
    return best.select("id", "cat", F.round("rating", 6).alias("rating"))


@query("seeded_sample", "select doc_id, source from documents order by md5(doc_id || ':42'), doc_id limit 100")
def seeded_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return docs.orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":42"))), "doc_id").limit(100)


@query("ordered_stories", f"select id, cat, section_title, round(rating, 6) as rating from {_RATED} where rating >= 1.5 order by cat, rating desc")
def ordered_stories(spark, d):
    kept = _rated(spark, d).filter("rating >= 1.5").orderBy("cat", F.desc("rating"))
    return kept.select("id", "cat", "section_title", F.round("rating", 6).alias("rating"))


# ------------------------------------------------------------------ aggregations


@query("source_counts", "select source, count(*) as n, cast(sum(1) as bigint) as ones from documents group by 1")
def source_counts(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.lit(1)).alias("ones"))


@query("value_counts", "select lang, count(*) as n from documents group by 1")
def value_counts(spark, d):
    return stats.value_counts(table(spark, d, "documents"), "lang")


@query("section_stats", f"select cat, section_title, round(avg(rating), 6) as rating, count(*) as count from {_RATED} group by 1, 2")
def section_stats(spark, d):
    return edits.section_stats(_rated(spark, d)).withColumn("rating", F.round("rating", 6))


@query("section_order", f"""
    with s as (select case when cat = 'fr' then 'Other' else cat end as cat, section_title, avg(rating) as rating, count(*) as count from {_RATED} group by 1, 2),
    o as (select *, case when cat = 'Other' then 0 else rating * ln(1 + count) end as score from s)
    select cat, section_title, round(rating, 6) as rating, count, round(score, 6) as score,
      row_number() over (order by score desc, cat, section_title) - 1 as sort_order from o""")
def section_order(spark, d):
    cat = F.when(F.col("cat") == "fr", "Other").otherwise(F.col("cat"))
    out = edits.section_order(_rated(spark, d).withColumn("cat", cat))
    return out.withColumn("rating", F.round("rating", 6)).withColumn("score", F.round("score", 6))


@query("story_order", f"""
    with o as (select cat, row_number() over (order by avg(rating) * ln(1 + count(*)) desc, cat, section_title) - 1 as n from {_RATED} group by cat, section_title)
    select id, cat, sort_order from {_RATED} join (select cat, max(n) as sort_order from o group by 1) using (cat)""")
def story_order(spark, d):
    rated = _rated(spark, d)
    return edits.add_section_order(rated.select("id", "cat"), edits.section_order(rated))


@query("distinct_counts", "select lang, count(distinct source) as n_sources, count(distinct text) as n_texts from documents group by 1")
def distinct_counts(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(
        F.count_distinct("source").alias("n_sources"), F.count_distinct(F.md5("text")).alias("n_texts"))


@query("coverage", """
    select count(*) as n, count(*) filter (text is not null and text <> '') as with_text, count(quality) as with_quality, count(toxic) as with_toxic,
      min(n_chars) as min_rating, max(n_chars) as max_rating, round(avg(n_chars), 6) as mean_rating, count(*) filter (n_chars >= 700) as n_good
    from documents left join labels using (doc_id)""")
def coverage(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    out = stats.coverage(joined, ["text", "quality", "toxic"], "n_chars", 700)
    return out.withColumn("mean_rating", F.round("mean_rating", 6))


@query("log_stats", """
    select user_id as session, case when grouping(event_type) = 0 then 'level' when grouping(step) = 0 then 'step' else 'all' end as part,
      event_type as level, step, count(*) as n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_ts
    from (select user_id, event_type, ts, case when event_id % 3 > 0 then 's' || event_id % 3 end as step from events)
    group by grouping sets ((user_id, event_type), (user_id, step), (user_id))
    having grouping(step) = 1 or step is not null""")
def log_stats(spark, d):
    step = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")))
    logs = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("level"), step.alias("step"), "ts")
    out = evaluate.log_stats(logs, "session", "level", "step", "ts")
    for name in ("first_ts", "last_ts"):
        out = out.withColumn(name, F.date_format(name, "yyyy-MM-dd HH:mm:ss"))
    return out


@query("newest_sessions", """
    select user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_update from events where ts > timestamp '2024-01-15'
    group by 1 order by max(ts) desc, user_id limit 50""")
def newest_sessions(spark, d):
    out = stats.newest_sessions(table(spark, d, "events").select("user_id", "ts"), "user_id", "ts", F.lit("2024-01-15").cast("timestamp_ntz"), 50)
    return out.withColumn("last_update", F.date_format("last_update", "yyyy-MM-dd HH:mm:ss"))


@query("latest_per_key", """
    select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id, arg_max(value, (ts, event_id)) as value from events group by 1, 2""")
def latest_per_key(spark, d):
    events = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return stats.latest_per_key(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("cluster_sizes", """
    with s as (select label - 1 as label, count(*) as n from embeddings group by 1)
    select count(*) filter (label <> -1) as n_clusters, cast(sum(n) filter (label = -1) as bigint) as n_noise,
      round(sum(n) filter (label = -1) / sum(n), 6) as noise_ratio, round(avg(n) filter (label <> -1), 6) as avg_size,
      round(stddev_pop(n) filter (label <> -1), 6) as std_size, min(n) filter (label <> -1) as min_size, max(n) filter (label <> -1) as max_size from s""")
def cluster_sizes(spark, d):
    out = stats.cluster_sizes(table(spark, d, "embeddings").select((F.col("label") - 1).alias("label")), "label")
    return out.withColumns({c: F.round(c, 6) for c in ("noise_ratio", "avg_size", "std_size")})


_PREDICTED = """
    (select model, doc_id as input, case model when 'length' then n_chars > 400 when 'early' then doc_id % 3 > 0 else contains(text, 'the') end as pred,
       quality = 1 as truth from documents join labels using (doc_id), (values ('length'), ('early'), ('word')) m(model))"""


def _compared(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "n_chars")
    verdicts = F.create_map(
        F.lit("length"), F.col("n_chars") > 400, F.lit("early"), F.col("doc_id") % 3 > 0, F.lit("word"), F.contains("text", F.lit("the")))
    predictions = docs.select(F.col("doc_id").alias("input"), F.explode(verdicts).alias("model", "output"))
    truth = table(spark, d, "labels").select(F.col("doc_id").alias("input"), (F.col("quality") == 1).alias("output"))
    return evaluate.compare(predictions, truth)


@query("eval_accuracy", f"""
    select model, round(avg((pred = truth)::int), 6) as accuracy, count(*) filter (pred = truth) as n_correct, count(*) as n from {_PREDICTED} group by 1""")
def eval_accuracy(spark, d):
    return evaluate.accuracy(_compared(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


@query("eval_confusion", f"select model, truth, pred, count(*) as n from {_PREDICTED} group by 1, 2, 3")
def eval_confusion(spark, d):
    return evaluate.confusion(_compared(spark, d))


@query("eval_errors", f"select model, input, pred, truth from {_PREDICTED} where pred <> truth")
def eval_errors(spark, d):
    return evaluate.wrong(_compared(spark, d))


@query("eval_common_errors", f"""
    select input, count(*) as n, array_to_string(list_sort(list_distinct(list(model))), ',') as models,
      array_to_string(list_sort(list_distinct(list(pred))), ',') as preds
    from {_PREDICTED} where pred <> truth group by 1 having count(*) > 1 order by n desc, input limit 10""")
def eval_common_errors(spark, d):
    out = evaluate.common_errors(_compared(spark, d))
    return out.withColumn("models", F.array_join("models", ",")).withColumn("preds", F.array_join(F.col("preds").cast("array<string>"), ","))


_STATUS = "case when event_type in ('view', 'click', 'purchase') then 'completed' when event_type = 'error' then 'failed' else 'pending' end"


@query("step_progress", f"""
    select {_STATUS} as status, count(*) as n, round(100.0 * (select count(*) from events where {_STATUS} = 'completed') / (select count(*) from events), 6) as progress
    from events group by 1""")
def step_progress(spark, d):
    status = F.when(F.col("event_type").isin("view", "click", "purchase"), "completed").when(F.col("event_type") == "error", "failed").otherwise("pending")
    out = stats.progress(table(spark, d, "events").select(status.alias("status")), "status")
    return out.withColumn("progress", F.round("progress", 6))


@query("step_durations", """
    select user_id, event_type, (s // 60) || ':' || lpad((s % 60)::varchar, 2, '0') as duration from
      (select user_id, event_type, cast(epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) as bigint) as s from events group by 1, 2)""")
def step_durations(spark, d):
    runs = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("started"), F.max("ts").alias("completed"))
    return evaluate.step_durations(runs, "started", "completed").select("user_id", "event_type", "duration")


_WORDS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@query("topic_frequency", f"""
    select topic, count(*) as n from (select unnest({_WORDS}) as topic from documents) group by 1 having count(*) >= 3 order by n desc, topic limit 50""")
def topic_frequency(spark, d):
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return stats.topic_frequency(texts(spark, d, "documents").select(words.alias("topics")), "topics")
