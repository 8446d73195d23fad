"""Queries over readers, sinks, filters, joins and the history."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsflow.functions import scores, text, urls
from newsflow.operators import dedup, edits, evaluate, history, model, numbering, stats
from newsflow.plans.registry import ITEMS, NOW, items, now, query, table
from newsflow.session import new_folder
from newsflow.sources import catalog, html, sinks, tables

# ------------------------------------------------------------------ sources


def _feed_entries(spark, d):
    docs = items(spark, d)
    return docs.select(
        F.col("id").alias("ord"), "source", "title",
        F.when(F.col("id") % 3 == 0, F.col("title")).when(F.col("id") % 3 == 1, F.col("lang")).alias("title_detail"),
        F.concat(F.lit("https://n.example/"), F.col("id").cast("string")).alias("url"),
        F.when(F.col("id") % 2 == 0, F.lit("2024-01-01")).alias("published"),
        F.when(F.col("id") % 4 > 1, F.col("text")).when(F.col("id") % 4 == 1, "").alias("summary"),
        F.col("lang").alias("description"),
    )


@query("feed_items", f"""
    select id as ord, source, case when id % 3 = 1 and lang <> title then title || ': ' || lang else title end as title,
      'https://n.example/' || id as url, case when id % 2 = 0 then '2024-01-01' else '' end as published,
      case when id % 4 > 1 and text <> '' then text else lang end as rss_summary
    from {ITEMS} qualify row_number() over (partition by source order by id) <= 50""")
def feed_items(spark, d):
    return tables.feed_items(_feed_entries(spark, d))


@query("api_items", f"""
    select id as ord, cast(0 as integer) as pos, 'NewsAPI' as source, title, 'https://n.example/' || id as url, '' as published from {ITEMS}
    union all
    select id, cast(1 as integer), 'NewsAPI', source, '', '2024-01-0' || (id % 9 + 1) from {ITEMS}""")
def api_items(spark, d):
    """Responses with two articles each, written as JSON and read back."""
    docs = items(spark, d)
    key = F.col("id").cast("string")
    first = F.struct(F.col("title"), F.concat(F.lit("https://n.example/"), key).alias("url"), F.lit(None).cast("string").alias("publishedAt"))
    second = F.struct(F.col("source").alias("title"), F.lit(None).cast("string").alias("url"),
                      F.concat(F.lit("2024-01-0"), (F.col("id") % 9 + 1).cast("string")).alias("publishedAt"))
    bodies = docs.select(F.col("id").alias("ord"), F.to_json(F.struct(F.array(first, second).alias("articles"))).alias("body"))
    return tables.api_items(bodies, "body", "NewsAPI")


def _source_catalog(spark, d):
    """Documents' sources as a catalogue, and one entry per supplier that never delivers."""
    docs = table(spark, d, "documents").select("source").distinct()
    kind = F.element_at(F.array(F.lit("rss"), F.lit("html")), (F.length("source") % 2 + 1).cast("int"))
    idle = table(spark, d, "supplier").select(
        F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, "rss").otherwise("ftp").alias("type"))
    return docs.select(F.col("source").alias("name"), kind.alias("type")).unionByName(idle)


@query("gather_sources", """
    select source as name, 'ok' as status, count(*) as n from documents group by 1
    union all select s_name, case when s_suppkey % 2 = 0 then 'no items' else 'unknown type' end, 0 from supplier""")
def gather_sources(spark, d):
    docs = items(spark, d).select("id", "source", "title")
    found, failed = tables.gather(_source_catalog(spark, d), {"rss": docs, "html": docs})
    counts = found.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    ok = counts.select("name", F.lit("ok").alias("status"), "n")
    return ok.unionByName(failed.select("name", F.col("reason").alias("status"), F.lit(0).cast("long").alias("n")))


@query("texts_by_path", """
    select doc_id as id, 'p/' || doc_id || '.txt' as text_path, n_chars from documents
    where doc_id % 5 > 1 and doc_id % 7 <> 0 and n_chars > 0""")
def texts_by_path(spark, d):
    docs = table(spark, d, "documents")
    name = F.concat(F.lit("p/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    wanted = docs.select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 5 > 1, name).when(F.col("doc_id") % 5 == 1, "download/text/.txt").alias("text_path"))
    texts = docs.filter("doc_id % 7 <> 0").select(name.alias("path"), "text")
    return tables.texts_by_path(wanted, texts).select("id", "text_path", F.length("text").cast("long").alias("n_chars"))


@query("newest_filtered", """
    select doc_id, source, n_chars from documents where lang is not null and lang <> '' and n_chars > 100
    order by doc_id desc limit 10000""")
def newest_filtered(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    return tables.newest_filtered(docs, ["lang"], "n_chars", 100, "doc_id", 10000).select("doc_id", "source", "n_chars")


@query("point_lookup", "select doc_id, source, lang, n_chars from documents where doc_id in (select item_id from benchmark)")
def point_lookup(spark, d):
    docs = tables.read_table(spark, f"{d}/documents.parquet").select("doc_id", "source", "lang", "n_chars")
    return tables.rows_by_key(docs, table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id")


@query("feed_cut", """
    with p as (select (select max(event_id) from events) - event_id as ord, event_id, ts,
                 event_type || ' ' || props as text from events)
    select event_id, text from p where ts >= (select max(ts) from events) - interval 30 hour
      and ord < coalesce((select min(ord) from p where text = 'view {"k": 42}'), 9223372036854775807)""")
def feed_cut(spark, d):
    events = table(spark, d, "events")
    last = events.select(F.max("event_id")).scalar()
    posts = events.select(
        (last - F.col("event_id")).alias("ord"), "event_id", "ts", F.concat_ws(" ", "event_type", "props").alias("text"))
    newest = events.select(F.max("ts")).scalar()
    return tables.newest_until(posts, 'view {"k": 42}', newest).select("event_id", "text")


@query("reorder_list", """
    select l_orderkey as list_id, pos, p_partkey, p_name from
      (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber desc, l_partkey, l_extendedprice) - 1 as pos from lineitem)
      join part on p_partkey = l_partkey where p_size > 10""")
def reorder_list(spark, d):
    """Parts in the order each order lists its lines backwards; parts filtered out are left out."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.struct(
        (-F.col("l_linenumber")).alias("n"), "l_partkey", "l_extendedprice").alias("s"))
    # An order has a handful of lines, so the list column is small.
    lists = lines.groupBy(F.col("l_orderkey").alias("list_id")).agg(
        F.transform(F.sort_array(F.collect_list("s")), lambda s: s["l_partkey"]).alias("wanted"))
    parts = table(spark, d, "part").filter("p_size > 10").select("p_partkey", "p_name")
    return tables.reorder(parts, "p_partkey", lists, "wanted").select("list_id", F.col("pos").cast("long").alias("pos"), "p_partkey", "p_name")


_CATALOG_SQL = """
    (select s_name as name, case s_suppkey % 6 when 0 then 'rss' when 1 then 'html' when 2 then 'rest' when 3 then 'ftp' when 4 then '' else 'html' end as type,
       case when s_suppkey % 4 > 0 then 'https://s.example/' || s_suppkey end as url,
       case when s_suppkey % 5 = 0 then '[' when s_suppkey % 5 = 1 then '^https' end as include,
       s_acctbal as scroll, s_suppkey from supplier)"""


@query("catalog_check", f"""
    with c as {_CATALOG_SQL}
    select name, 'ERROR' as level, 'missing type' as issue from c where type = ''
    union all select name, 'ERROR', 'invalid type ftp' from c where type = 'ftp'
    union all select name, 'ERROR', 'rss source needs rss or url' from c where type = 'rss' and url is null
    union all select name, 'ERROR', 'html source needs url' from c where type = 'html' and url is null
    union all select name, 'ERROR', 'rest source needs function_name' from c where type = 'rest'
    union all select name, 'WARNING', 'scroll should be positive' from c where type in ('rss', 'html', 'rest') and scroll <= 0
    union all select name, 'ERROR', 'invalid regex in include: [' from c where type in ('rss', 'html', 'rest') and include = '['""")
def catalog_check(spark, d):
    s = table(spark, d, "supplier")
    key = F.col("s_suppkey")
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("rss", "html", "rest", "ftp", "", "html")]), (key % 6 + 1).cast("int"))
    none = F.lit(None)
    entries = s.select(
        F.col("s_name").alias("name"), kinds.alias("type"),
        F.when(key % 4 > 0, F.concat(F.lit("https://s.example/"), key.cast("string"))).alias("url"),
        none.cast("string").alias("rss"), none.cast("string").alias("function_name"),
        F.when(key % 5 == 0, F.array(F.lit("["))).when(key % 5 == 1, F.array(F.lit("^https"))).alias("include"),
        none.cast("array<string>").alias("exclude"), F.col("s_acctbal").alias("scroll"),
        none.cast("double").alias("initial_sleep"), none.cast("double").alias("minlength"),
    )
    return catalog.check_catalog(entries)


@query("fetch_summary", """
    select count(*) filter (page_id % 10 <> 3) as n_ok, count(*) filter (page_id % 10 = 3) as n_failed,
      cast(sum(strlen(html)) filter (page_id % 10 <> 3) as bigint) as total_bytes from pages""")
def fetch_summary(spark, d):
    pages = table(spark, d, "pages").select("html", F.when(F.col("page_id") % 10 == 3, 404).otherwise(200).alias("status"))
    return evaluate.fetch_summary(pages, urls.http_status_ok("status"), "html")


@query("fetch_records", """
    select page_id, url, case when page_id % 10 = 3 then 404 else 200 end as status_code,
      case when page_id % 10 = 3 or html is null then 'failed' else 'success' end as status,
      cast(case when page_id % 10 = 3 or html is null then 0 else strlen(html) end as bigint) as file_size_bytes from pages""")
def fetch_records(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", "html", F.when(F.col("page_id") % 10 == 3, 404).otherwise(200).alias("status_code"))
    return evaluate.fetch_records(pages, urls.http_status_ok("status_code"), "html", ["page_id", "url", "status_code"])


# ------------------------------------------------------------------ sinks


@query("upsert_latest", """
    select coalesce(n.k, o.k) as k, case when n.k is null then o.price else n.price end as price,
      case when n.k is null then o.status else n.status end as status
    from (select o_custkey as k, max_by(o_totalprice, o_orderkey) as price, max_by(o_orderstatus, o_orderkey) as status
          from orders where o_orderkey % 2 = 0 group by 1) o
    full join (select o_custkey as k, max_by(o_totalprice, o_orderkey) as price, max_by(o_orderstatus, o_orderkey) as status
          from orders where o_orderkey % 2 = 1 group by 1) n on o.k = n.k""")
def upsert_latest(spark, d):
    orders = table(spark, d, "orders").select(
        F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), "o_orderkey")
    newest = [F.desc("o_orderkey")]
    stored = dedup.first_per_key(orders.filter("o_orderkey % 2 = 0"), ["k"], newest)
    return sinks.upsert(stored, orders.filter("o_orderkey % 2 = 1"), ["k"], newest).drop("o_orderkey")


@query("upsert_keep_created", """
    select coalesce(n.k, o.k) as k, coalesce(n.price, o.price) as price,
      strftime(coalesce(o.created, n.created), '%Y-%m-%d') as created
    from (select o_custkey as k, arg_max(o_totalprice, o_orderkey) as price, arg_max(o_orderdate, o_orderkey) as created
          from orders where o_orderkey % 2 = 0 group by 1) o
    full join (select o_custkey as k, arg_max(o_totalprice, o_orderkey) as price, arg_max(o_orderdate, o_orderkey) as created
          from orders where o_orderkey % 2 = 1 group by 1) n on o.k = n.k""")
def upsert_keep_created(spark, d):
    orders = table(spark, d, "orders").select(
        F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("created"), "o_orderkey")
    newest = [F.desc("o_orderkey")]
    stored = dedup.first_per_key(orders.filter("o_orderkey % 2 = 0"), ["k"], newest).drop("o_orderkey")
    out = sinks.upsert(stored, orders.filter("o_orderkey % 2 = 1"), ["k"], newest, keep=["created"])
    return out.withColumn("created", F.date_format("created", "yyyy-MM-dd"))


@query("history_write", """
    select split_part(url, '?', 1) as initial_url,
      coalesce(min(case when page_id % 3 > 0 then null when page_id % 2 = 0 then 'https://f.example/' || page_id else split_part(url, '?', 1) end), '') as final_url,
      bool_or(page_id % 5 = 0) as ai, case when bool_or(page_id % 4 = 0) then '2024-01-01' else '2024-01-31' end as created
    from pages group by 1""")
def history_write(spark, d):
    """A row per address, of which several pages may be known: the first of the final addresses, marked if any page is."""
    pages = table(spark, d, "pages").select("page_id", urls.clean_url("url").alias("url"))
    gathered = pages.select("url", F.lit("t").alias("title"), F.lit("s").alias("source"),
                            F.when(F.col("page_id") % 5 == 0, True).alias("isAI"))
    final = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://f.example/"), F.col("page_id").cast("string"))).otherwise("")
    downloaded = pages.filter("page_id % 3 = 0").select("url", final.alias("final_url"))
    stored = pages.filter("page_id % 4 = 0").select(
        F.col("url").alias("initial_url"), F.lit("old").alias("final_url"), F.lit("o").alias("title"), F.lit("o").alias("source"),
        F.lit(False).alias("isAI"), F.to_timestamp(F.lit("2024-01-01")).alias("created_at")).distinct()
    out = sinks.write_history(stored, sinks.history_rows(gathered, downloaded, now()))
    return out.select("initial_url", "final_url", F.col("isAI").alias("ai"), F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("article_rows", f"""
    select id, coalesce(rep, 0.0) as reputation, cast(len as bigint) as content_length, coalesce(title, '') as title, topics, day
    from (select id, case when id % 2 = 0 then id / 4 end as rep, n_chars as len, case when id % 3 > 0 then title end as title,
            case when id % 4 = 0 then '' else source || ',' || lang end as topics,
            case when id % 5 = 0 then '2024-01-31' else '2023-12-01' end as day from {ITEMS})""")
def article_rows(spark, d):
    df = items(spark, d).select(
        "id", F.when(F.col("id") % 2 == 0, F.col("id") / 4).alias("reputation"), F.col("n_chars").cast("string").alias("content_length"),
        F.when(F.col("id") % 3 > 0, F.col("title")).alias("title"),
        F.when(F.col("id") % 4 > 0, F.array("source", F.lit(" "), "lang")).alias("topics"),
        F.when(F.col("id") % 5 > 0, F.to_timestamp(F.lit("2023-12-01"))).alias("date"))
    out = sinks.article_rows(df, {"reputation": 0.0, "content_length": 0, "title": ""}, {"content_length": "bigint"}, now())
    return out.select("id", "reputation", "content_length", "title", "topics", F.date_format("date", "yyyy-MM-dd").alias("day"))


@query("delete_keys", """
    select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)""")
def delete_keys(spark, d):
    gone = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return sinks.delete_keys(table(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, ["o_custkey"])


@query("deleted_counts", """
    select o_orderstatus, count(*) as n_deleted from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0) group by 1""")
def deleted_counts(spark, d):
    gone = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return sinks.deleted_per_group(table(spark, d, "orders").select("o_custkey", "o_orderstatus"), gone, ["o_custkey"], "o_orderstatus")


@query("group_json", """
    select lang, row_number() over (partition by lang order by n_chars desc, doc_id) as pos,
      '{"id":' || doc_id || ',"size":' || n_chars || '}' as json from documents""")
def group_json(spark, d):
    docs = table(spark, d, "documents").select("lang", "doc_id", "n_chars")
    return sinks.group_json(docs, "lang", [F.desc("n_chars"), "doc_id"], {"doc_id": "id", "n_chars": "size"})


@query("document_lines", f"""
    with o as (select lang, row_number() over (order by lang) - 1 as section_order from documents group by lang)
    select section_order, row_number() over (partition by lang order by n_chars desc, id) as pos, '- ' || source || ' ' || id as line
    from {ITEMS} join o using (lang)
    union all select section_order, 0, '## ' || lang from o""")
def document_lines(spark, d):
    df = items(spark, d).select("id", "lang", "source", "n_chars")
    order = numbering.number_rows(df.select("lang").distinct(), ["lang"], "_n").select("lang", (F.col("_n") - 1).alias("section_order"))
    line = F.concat(F.lit("- "), "source", F.lit(" "), F.col("id").cast("string"))
    return sinks.document_lines(df.join(order, "lang"), "section_order", "lang", [F.desc("n_chars"), "id"], line)


@query("latest_snapshot", """
    select user_id as session, event_type as step, max(event_id) as event_id, max_by(value, event_id) as value from events group by 1, 2""")
def latest_snapshot(spark, d):
    """Newest state per (session, step), from snapshots of two steps written and read back."""
    log = table(spark, d, "events").select(F.col("user_id").alias("owner"), F.col("event_type").alias("kind"), "event_id", "value")
    root = new_folder(spark, "snapshots")
    sinks.write_snapshot(log.limit(0), root, "all", "states")
    sinks.write_snapshot(stats.latest_per_key(log, ["owner", "kind"], ["event_id"]), root, "all", "states")  # a repeated step replaces its own
    sinks.write_snapshot(log, root, "all", "raw")
    back = sinks.read_snapshot(spark, root, "all", "states")
    return back.select(F.col("owner").alias("session"), F.col("kind").alias("step"), "event_id", "value")


@query("latest_trial", "select event_id, value as score, props as config from events order by ts desc, event_id desc limit 1")
def latest_trial(spark, d):
    """Trials appended in two goes and the newest read back."""
    stamp = F.struct("ts", "event_id").alias("timestamp")
    trials = table(spark, d, "events").select("event_id", F.col("value").alias("score"), F.col("props").alias("config"), stamp)
    path = new_folder(spark, "trials")
    for half in (F.col("event_id") % 2 == 1, F.col("event_id") % 2 == 0):
        sinks.append_trial(trials.filter(half), path)
    return sinks.latest_trial(spark, path).select("event_id", "score", "config")


# ------------------------------------------------------------------ filters


@query("relevant_items", """
    select doc_id, quality from documents left join labels using (doc_id)
    where coalesce(quality = 1, false) and text is not null and text <> '' and n_chars / 1000.0 >= 0.5""")
def relevant_items(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "n_chars")
    joined = docs.join(table(spark, d, "labels"), "doc_id", "left")
    relevant = F.coalesce(F.col("quality") == 1, F.lit(False))
    filled = F.col("text").isNotNull() & (F.col("text") != "")
    return joined.filter(relevant & filled & (F.col("n_chars") / 1000.0 >= 0.5)).select("doc_id", "quality")


@query("prefix_filters", """
    select doc_id, source from documents
    where left(text, 2) in ('Th', 'On', 'In', 'Er') or (not starts_with(source, 'src1') and starts_with(text, 'A'))""")
def prefix_filters(spark, d):
    docs = table(spark, d, "documents")
    listed = F.substring("text", 1, 2).isin("Th", "On", "In", "Er")
    other = ~F.col("source").startswith("src1") & F.col("text").startswith("A")
    return docs.filter(listed | other).select("doc_id", "source")


@query("missing_report", """
    select page_id, url, 'no file' as reason from pages where page_id % 6 = 0""")
def missing_report(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", F.when(F.col("page_id") % 6 > 0, "x.html").otherwise("").alias("html_path"))
    return pages.filter(F.col("html_path") == "").select("page_id", "url", F.lit("no file").alias("reason"))


@query("fill_defaults", """
    select doc_id, coalesce(quality, 0) as quality, coalesce(toxic, 1) as toxic, n_chars as content_length from documents left join labels using (doc_id)""")
def fill_defaults(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.fillna({"quality": 0, "toxic": 1}).withColumnRenamed("n_chars", "content_length")


@query("log_search", """
    select event_id as id, event_type as level, value from events where event_type = 'error' and user_id = 8
    order by event_id desc limit 100""")
def log_search(spark, d):
    logs = table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("agent_session"), F.col("event_type").alias("level"), "value",
        F.lit("x").alias("step_name"))
    return evaluate.find_logs(logs, 100, session=8, level="error").select("id", "level", "value")


# ------------------------------------------------------------------ joins


@query("attach_results", """
    select o_orderkey, o_custkey, c_name, coalesce(c_mktsegment, 'none') as segment from orders left join
      (select * from customer where c_acctbal > 0) on o_custkey = c_custkey""")
def attach_results(spark, d):
    results = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return orders.join(results, "o_custkey", "left").select(
        "o_orderkey", "o_custkey", "c_name", F.coalesce("c_mktsegment", F.lit("none")).alias("segment"))


@query("site_lookup", """
    select c_custkey, 'n' || c_nationkey as domain, coalesce(n_name, '') as site_name, coalesce(n_regionkey, 0)::double as reputation
    from customer left join (select * from nation where n_nationkey < 20) on c_nationkey = n_nationkey""")
def site_lookup(spark, d):
    sites = table(spark, d, "nation").filter("n_nationkey < 20").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("domain_name"), F.col("n_name").alias("site_name"),
        F.col("n_regionkey").cast("double").alias("reputation"))
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("domain"))
    return model.add_sites(rows, sites)


_DOMAIN = r"array_to_string(string_split(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '.')[-2:], '.')"
_HOST = r"regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


@query("new_sites", rf"""
    select {_HOST} as domain_name, array_to_string(list_transform(string_split(replace(split_part({_HOST}, '.', 1), '-', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') as site_name,
      0.0::double as reputation
    from pages group by 1, 2 having min(page_id % 4) > 0""")
def new_sites(spark, d):
    pages = table(spark, d, "pages").select("page_id", urls.host("url").alias("domain"))
    known = pages.filter("page_id % 4 = 0").select(F.col("domain").alias("domain_name"), F.lit("known").alias("site_name")).distinct()
    return model.new_sites(pages, known)


_SEEN_ITEMS = rf"""
    (select page_id as id, split_part(url, '?', 1) as url, {_HOST} as source, 't' || page_id % 40 as title from pages)"""
_SEEN_HISTORY = rf"""
    (select split_part(url, '?', 1) as initial_url, {_HOST} as source, 't' || (page_id + 1) % 40 as title,
            timestamp '2024-01-01' + to_days(cast(page_id % 10 as integer)) as created_at
     from pages where page_id % 3 = 0)"""


def _seen(spark, d):
    pages = table(spark, d, "pages").select("page_id", urls.clean_url("url").alias("url"), urls.host("url").alias("source"))

    def title(shift):
        return F.concat(F.lit("t"), ((F.col("page_id") + shift) % 40).cast("string"))

    rows = pages.select(F.col("page_id").alias("id"), "url", "source", title(0).alias("title"))
    created = F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval((F.col("page_id") % 10).cast("int"))
    stored = pages.filter("page_id % 3 = 0").select(
        F.col("url").alias("initial_url"), F.lit("").alias("final_url"), "source", title(1).alias("title"), created.alias("created_at"))
    return rows, stored


@query("seen_url_antijoin", f"""
    select id, url from {_SEEN_ITEMS} i
    where url not in (select initial_url from {_SEEN_HISTORY})
      and (source, title) not in (select (source, title) from {_SEEN_HISTORY})""")
def seen_url_antijoin(spark, d):
    rows, stored = _seen(spark, d)
    return history.unseen_items(rows, stored).select("id", "url")


@query("seen_url_since", f"""
    with h as {_SEEN_HISTORY},
    m as (select i.id, i.url, (select max(created_at) from h where h.initial_url = i.url) as u_at,
            (select max(created_at) from h where h.source = i.source and h.title = i.title) as t_at from {_SEEN_ITEMS} i)
    select id, url from m where case when u_at is not null then u_at > timestamp '2024-01-05'
      when t_at is not null then t_at > timestamp '2024-01-05' else true end""")
def seen_url_since(spark, d):
    rows, stored = _seen(spark, d)
    return history.unseen_items(rows, stored, F.to_timestamp(F.lit("2024-01-05"))).select("id", "url")


@query("seen_after_cutoff", """
    with h as (select cast(user_id as varchar) || event_type as u, max(ts) as seen_at from events where event_id % 7 = 0 group by 1)
    select event_id from events left join h on h.u = cast(user_id as varchar) || event_type
    where seen_at is null or seen_at > timestamp '2024-01-29'""")
def seen_after_cutoff(spark, d):
    key = F.concat(F.col("user_id").cast("string"), "event_type")
    events = table(spark, d, "events").select("event_id", "event_type", key.alias("url"), F.col("ts").cast("timestamp").alias("ts"))
    rows = events.select(F.col("event_id").alias("id"), "url", F.lit("s").alias("source"), F.col("event_id").cast("string").alias("title"))
    stored = events.filter("event_id % 7 = 0").select(
        F.col("url").alias("initial_url"), F.lit("h").alias("source"), F.lit("h").alias("title"), F.col("ts").alias("created_at"))
    return history.unseen_items(rows, stored, F.to_timestamp(F.lit("2024-01-29"))).select(F.col("id").alias("event_id"))


_TD_ITEMS = rf"""
    (select page_id as id, case when page_id % 11 > 0 then url else '' end as final_url, 't' || page_id % 12 as title, {_DOMAIN} as domain from pages)"""
_TD_HISTORY = rf"""
    (select case when page_id % 2 = 0 then url else '' end as final_url, upper(split_part(url, '?', 1)) as initial_url, 't' || page_id % 12 as title,
            timestamp '2024-01-01' + to_days(cast(page_id % 10 as integer)) as created_at from pages where page_id % 9 = 0)"""


def _redirected(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", F.concat(F.lit("t"), (F.col("page_id") % 12).cast("string")).alias("title"))
    rows = pages.select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 11 > 0, F.col("url")).otherwise("").alias("final_url"), "title")
    created = F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval((F.col("page_id") % 10).cast("int"))
    stored = pages.filter("page_id % 9 = 0").select(
        F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise("").alias("final_url"),
        F.upper(urls.clean_url("url")).alias("initial_url"), "title", created.alias("created_at"))
    return rows, stored


@query("title_domain_antijoin", f"""
    select id from {_TD_ITEMS} i where final_url = '' or not exists (
      select 1 from {_TD_HISTORY} h where h.final_url = i.final_url
        or (h.title = i.title and (contains(lower(h.final_url), i.domain) or contains(lower(h.initial_url), i.domain))))""")
def title_domain_antijoin(spark, d):
    rows, stored = _redirected(spark, d)
    return history.unseen_after_redirect(rows, stored).select("id")


@query("title_domain_since", f"""
    with h as {_TD_HISTORY},
    m as (select i.id, i.final_url, (select max(created_at) from h where h.final_url = i.final_url and h.final_url <> '') as f_at,
            (select max(created_at) from h where h.title = i.title and (contains(lower(h.final_url), i.domain) or contains(lower(h.initial_url), i.domain))) as t_at
          from {_TD_ITEMS} i)
    select id from m where final_url = '' or case when f_at is not null then f_at > timestamp '2024-01-06'
      when t_at is not null then t_at > timestamp '2024-01-06' else true end""")
def title_domain_since(spark, d):
    rows, stored = _redirected(spark, d)
    return history.unseen_after_redirect(rows, stored, F.to_timestamp(F.lit("2024-01-06"))).select("id")


@query("ids_without", "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")
def ids_without(spark, d):
    large = table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(large, "c_custkey", "left_anti")


@query("set_differences", """
    select coalesce(s.conv_id, r.conv_id) as conv_id, coalesce(s.k, r.k) as k, s.pos as sent_pos, r.pos as received_pos,
      case when r.pos is null then 'missing' when s.pos is null then 'extra' when s.pos <> r.pos then 'moved' else 'ok' end as status
    from (select conv_id, turn // 2 as k, row_number() over (partition by conv_id order by turn) as pos from conversations where role = 'user') s
    full join (select conv_id, turn // 2 as k, row_number() over (partition by conv_id order by turn) as pos from conversations where role = 'assistant' and turn % 5 > 0) r
      on s.conv_id = r.conv_id and s.k = r.k""")
def set_differences(spark, d):
    sent, received = _turns(spark, d)
    return dedup.id_set_differences(sent, received, ["conv_id", "k"], "pos")


def _turns(spark, d):
    from pyspark.sql import Window

    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    # A conversation is one short exchange.
    order = Window.partitionBy("conv_id").orderBy("turn")
    keyed = turns.withColumn("k", F.floor(F.col("turn") / 2))
    sent = keyed.filter("role = 'user'").withColumn("pos", F.row_number().over(order).cast("long"))
    received = keyed.filter("role = 'assistant' and turn % 5 > 0").withColumn("pos", F.row_number().over(order).cast("long"))
    return sent, received


@query("validate_response", """
    with b as (select coalesce(s.conv_id, r.conv_id) as chunk, s.pos as sp, r.pos as rp
      from (select conv_id, turn // 2 as k, row_number() over (partition by conv_id order by turn) as pos from conversations where role = 'user') s
      full join (select conv_id, turn // 2 as k, row_number() over (partition by conv_id order by turn) as pos from conversations where role = 'assistant' and turn % 5 > 0) r
        on s.conv_id = r.conv_id and s.k = r.k),
    c as (select chunk, count(sp) as n_sent, count(rp) as n_received, count(*) filter (rp is null) as n_missing,
            count(*) filter (sp is null) as n_extra, count(*) filter (sp <> rp) as n_moved from b group by 1)
    select *, case when n_sent <> n_received then 'count mismatch' when n_missing > 0 or n_extra > 0 then 'id mismatch'
      when n_moved > 0 then 'order mismatch' else 'ok' end as verdict from c""")
def validate_response(spark, d):
    sent, received = _turns(spark, d)
    return model.response_report(
        sent.select(F.col("conv_id").alias("chunk"), "pos", F.col("k").alias("id")),
        received.select(F.col("conv_id").alias("chunk"), "pos", F.col("k").alias("id")))


@query("crawl_plan", rf"""
    select page_id, {_HOST} as host, 5.0::double * (row_number() over (partition by {_HOST} order by page_id) - 1) as earliest_s from pages""")
def crawl_plan(spark, d):
    pages = table(spark, d, "pages").select("page_id", urls.host("url").alias("host"))
    return edits.crawl_plan(pages, "host", ["page_id"], 5.0)
