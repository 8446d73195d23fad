"""Queries over section edits, model columns, summaries and the stream of new items."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsflow.functions.text import or_other
from newsflow.operators import edits, model
from newsflow.operators.numbering import number_rows
from newsflow.plans.registry import ITEMS, items, query, table, texts
from newsflow.session import cut_lineage, shared_dir

# ------------------------------------------------------------------ edits

_EDITS = f"""
    (select 1 as ord, id, case id % 5 when 0 then 'rewrite' when 1 then 'move' when 2 then 'drop' when 3 then 'keep' else 'move' end as action,
       'new ' || id as head, case when id % 5 = 1 then 'de' else 'nowhere' end as target from {ITEMS}
     union all select 2, id, 'move', null, 'es' from {ITEMS} where id % 6 = 0
     union all select 3, id, 'rewrite', case when id % 14 = 0 then '' else 'third ' || id end, null from {ITEMS} where id % 7 = 0
     union all select 4, id, 'drop', null, null from {ITEMS} where id % 35 = 0)"""


def _stories(spark, d):
    return items(spark, d).select(
        "id", F.col("lang").alias("cat"), F.concat(F.lit("S "), "lang").alias("section_title"), F.col("title").alias("headline"),
        F.lit(True).alias("prune"))


def _edits(spark, d):
    df = items(spark, d).select("id")
    key = F.col("id").cast("string")
    none = F.lit(None).cast("string")
    kinds = F.array(*[F.lit(x) for x in ("rewrite", "move", "drop", "keep", "move")])

    def edit(ord, rows, action, head, target):
        return rows.select(F.lit(ord).alias("ord"), "id", action.alias("action"), head.alias("rewritten_headline"), target.alias("target_category"))

    first = edit(1, df, F.element_at(kinds, (F.col("id") % 5 + 1).cast("int")), F.concat(F.lit("new "), key),
                 F.when(F.col("id") % 5 == 1, "de").otherwise("nowhere"))
    second = edit(2, df.filter("id % 6 = 0"), F.lit("move"), none, F.lit("es"))
    third = edit(3, df.filter("id % 7 = 0"), F.lit("rewrite"), F.when(F.col("id") % 14 == 0, "").otherwise(F.concat(F.lit("third "), key)), none)
    fourth = edit(4, df.filter("id % 35 = 0"), F.lit("drop"), none, none)
    return first.unionByName(second).unionByName(third).unionByName(fourth)


_APPLIED = f"""
    with e as (select * from {_EDITS}),
    valid as (select *, action = 'drop' as is_drop, action = 'move' and target in (select lang from documents) as is_move,
                action = 'rewrite' and coalesce(head, '') <> '' as is_rewrite from e),
    net as (select id, bool_or(is_drop) as pruned, arg_max(head, ord) filter (is_rewrite) as head,
              arg_max(case when is_drop then 'Other' else target end, ord) filter (is_drop or is_move) as place from valid group by 1),
    done as (select id, coalesce(place, lang) as cat, case when place = 'Other' then 'Other News' else 'S ' || coalesce(place, lang) end as section_title,
      coalesce(head, title) as headline, coalesce(pruned, false) as prune from {ITEMS} left join net using (id))"""


@query("apply_edits", f"{_APPLIED} select * from done")
def apply_edits(spark, d):
    titles = table(spark, d, "documents").select(F.col("lang").alias("cat")).distinct().withColumn("section_title", F.concat(F.lit("S "), "cat"))
    return edits.apply_edits(_stories(spark, d), _edits(spark, d), titles)


@query("pruned_stories", f"{_APPLIED} select id, cat from done where not prune")
def pruned_stories(spark, d):
    return edits.drop_pruned(apply_edits(spark, d)).select("id", "cat")


_COARSE = f"(select id, lang || ' ' || (n_chars // 400) as cat, source as section_title, n_chars from {ITEMS})"


def _coarse(spark, d):
    cat = F.concat_ws(" ", "lang", F.floor(F.col("n_chars") / 400).cast("string"))
    return items(spark, d).select("id", cat.alias("cat"), F.col("source").alias("section_title"), "n_chars")


@query("singles_to_other", f"""
    with s as (select distinct cat from (select cat, section_title from {_COARSE} group by 1, 2 having count(*) = 1))
    select id, case when cat in (from s) then 'Other' else cat end as cat, case when cat in (from s) then 'Other News' else section_title end as section_title from {_COARSE}""")
def singles_to_other(spark, d):
    return edits.singles_to_other(_coarse(spark, d).drop("n_chars"))


@query("reassign_singles", f"""
    with n as (select cat, count(*) as n from {_COARSE} group by 1)
    select id, case when n > 1 then cat when id % 2 = 0 then (select min(cat) from n where n > 1) else 'Other' end as cat from {_COARSE} join n using (cat)""")
def reassign_singles(spark, d):
    """Even ids are given the first larger category, the others get no answer."""
    def first_candidate(rows, candidates):
        best = candidates.filter("cat <> 'Other'").select(F.min("cat")).scalar()
        return rows.filter("id % 2 = 0").select("id", best.alias("cat"))

    return edits.reassign_single_categories(_coarse(spark, d).select("id", "cat"), first_candidate)


@query("reassign_by_centroid")
def reassign_by_centroid(spark, d):
    """Default repair: the most similar category centroid, Other below the floor."""
    emb = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    rows = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.when(F.col("vec_id") % 50 == 7, F.concat(F.lit("single "), F.col("vec_id").cast("string"))).otherwise(F.col("label").cast("string")).alias("cat"))
    centres = cut_lineage(model.category_centroids(rows, emb, "id", "cat"))

    def nearest(alone, candidates):
        return model.assign_by_centroid(alone, emb, centres.join(candidates, "cat", "left_semi"), "id", "cat", 0.1)

    return edits.reassign_single_categories(rows, nearest)


@query("flatten_sections", """
    with l as (select l_orderkey, l_partkey, l_extendedprice, l_suppkey, l_quantity,
                 row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as pos from lineitem)
    select l_partkey as id, 'c' || (l_orderkey % 9) as cat, 'o' || l_orderkey as section_title, 'h' || l_suppkey as headline, l_quantity as rating,
      false as prune, '[s' || l_suppkey || '](https://s.example/' || l_partkey || ')' as links
    from l qualify row_number() over (partition by l_partkey order by l_orderkey, pos) = 1""")
def flatten_sections(spark, d):
    """Orders as nested sections of their few lines; a part counts in its first order."""
    lines = table(spark, d, "lineitem")
    link = F.struct(
        F.concat(F.lit("https://s.example/"), F.col("l_partkey").cast("string")).alias("url"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("site_name"))
    story = F.struct(
        F.col("l_partkey").alias("id"), F.col("l_quantity").alias("rating"), F.concat(F.lit("h"), F.col("l_suppkey").cast("string")).alias("headline"),
        F.lit(False).alias("prune"), F.array(link).alias("links"))
    entry = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", story.alias("s"))
    sections = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(entry)).alias("e")).select(
        F.concat(F.lit("c"), (F.col("l_orderkey") % 9).cast("string")).alias("cat"),
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("section_title"),
        F.col("l_orderkey").alias("ord"), F.transform("e", lambda x: x["s"]).alias("headlines"))
    return edits.flatten_sections(sections)


@query("weak_sections", """
    select event_id, value % 10 as coherence, (value * 3) % 10 as quality, user_id % 3 > 0 as should_iterate from events
    where user_id % 3 > 0 and (value % 10 < 7 or (value * 3) % 10 < 7)""")
def weak_sections(spark, d):
    critiques = table(spark, d, "events").select(
        "event_id", (F.col("value") % 10).alias("coherence"), ((F.col("value") * 3) % 10).alias("quality"), (F.col("user_id") % 3 > 0).alias("should_iterate"))
    return edits.weak_sections(critiques)


# ------------------------------------------------------------------ models


def _length_model(chunk: list[dict]) -> list[dict]:
    return [{"id": r["id"], "size": len(r["text"])} for r in chunk]


@query("model_column", "select doc_id as id, length(text) as size from documents")
def model_column(spark, d):
    """A stand-in model that answers with the length of the text, asked in chunks of 25."""
    docs = texts(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return model.model_column(docs, _length_model, ["text"], "size", "bigint")


def _grumpy_model(chunk: list[dict]) -> list[dict]:
    if any(r["id"] % 40 == 0 for r in chunk):
        raise RuntimeError("no answer")
    return [{"id": r["id"], "score": 1.0} for r in chunk]


@query("model_defaults", "select doc_id as id, case when doc_id % 40 = 0 then 0.5::double else 1.0::double end as score from documents")
def model_defaults(spark, d):
    """Chunks of one row whose model fails for some rows: these get the default."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    return model.model_column(docs, _grumpy_model, ["lang"], "score", "double", chunk_size=1, attempts=1, default=0.5, on_error="default")


@query("rule_scores", """
    select doc_id, least((case when regexp_matches(lower(text), '\\bthe\\b') then 0.25 else 0 end + case when regexp_matches(lower(text), 'tion') then 0.25 else 0 end
      + case when regexp_matches(lower(text), '[0-9]{4}') then 0.25 else 0 end + 0.1)::double, 1.0::double) as confidence from documents""")
def rule_scores(spark, d):
    patterns = [r"\bthe\b", "tion", "[0-9]{4}"]
    return texts(spark, d, "documents").select("doc_id", model.rule_confidence("text", patterns, 0.1).alias("confidence"))


@query("answers_with_default", """
    select doc_id, n_chars, coalesce(quality::double, 1.0::double) as quality from documents left join labels using (doc_id)""")
def answers_with_default(spark, d):
    answers = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    return model.with_default(table(spark, d, "documents").select("doc_id", "n_chars"), answers, "doc_id", "quality", 1.0)


@query("assign_categories", """
    with dims as (select label, generate_subscripts(embedding, 1) as i, unnest(embedding::double[]) as x from embeddings),
    c as (select label, list(m order by i) as centre from (select label, i, avg(x) as m from dims group by 1, 2) group by 1),
    s as (select vec_id, 'c' || c.label as cat, list_cosine_similarity(embedding::double[], centre) as sim from embeddings, c)
    select vec_id, case when sim >= 0.2 then cat else 'Other' end as cat from s qualify row_number() over (partition by vec_id order by sim desc) = 1""")
def assign_categories(spark, d):
    emb = table(spark, d, "embeddings").select("vec_id", "embedding")
    rows = table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("c"), F.col("label").cast("string")).alias("cat"))
    centres = model.category_centroids(rows, emb, "vec_id", "cat")
    return model.assign_by_centroid(rows.select("vec_id"), emb, centres, "vec_id", "cat", 0.2)


@query("category_proposal", f"""
    with t as (select unnest([source, lang, split_part(text, ' ', 1)]) as topic, n_chars / 1000.0 as rating from {ITEMS}),
    s as (select topic, avg(rating) as mean_rating, count(*) as n from t group by 1)
    select topic, round(mean_rating, 6) as mean_rating, n, round(mean_rating * ln(1 + n), 6) as priority from s
    order by mean_rating * ln(1 + n) desc, s.mean_rating desc, topic limit 30""")
def category_proposal(spark, d):
    df = items(spark, d).select(F.array("source", "lang", F.substring_index("text", " ", 1)).alias("topics"), (F.col("n_chars") / 1000.0).alias("rating"))
    out = model.propose_categories(df, "topics", "rating")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_rating", "priority")})


@query("clean_categories", f"""
    select min(trim(cat)) as cat from (select upper(lang) as cat from {ITEMS} union all select lang || ' ' from {ITEMS} union all select source from {ITEMS} union all select ' ' from {ITEMS})
    where trim(cat) <> '' group by lower(trim(cat))""")
def clean_categories(spark, d):
    df = items(spark, d)
    return model.clean_categories(
        df.select(F.upper("lang").alias("cat")), df.select(F.concat("lang", F.lit(" ")).alias("cat")), df.select(F.col("source").alias("cat")),
        df.select(F.lit(" ").alias("cat")))


_SENTENCES = r"""
    pieces as (select doc_id, string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+') as p from documents),
    raw as (select doc_id, generate_subscripts(p, 1) - 1 as pos, regexp_replace(unnest(p), '^\s+|\s+$', '', 'g') as sentence from pieces),
    sent as (select * from raw where sentence <> ''),
    words as (select doc_id, pos, unnest(list_filter(string_split_regex(lower(sentence), '[^\p{L}\p{N}]+'), lambda w: w <> '')) as w from sent),
    idf as (select w, ln((1 + (select count(*) from documents)) / (1 + count(distinct doc_id))) as idf from words group by 1),
    scored as (select doc_id, pos, round(sum(idf), 6) as score from words join idf using (w) group by 1, 2),
    best as (select * from scored qualify row_number() over (partition by doc_id order by score desc, pos) <= 3)"""


@query("summary_extract", f"""
    with {_SENTENCES}
    select doc_id, cast(pos as integer) as pos, sentence, score from best join sent using (doc_id, pos)""")
def summary_extract(spark, d):
    best = model.extract_summary(texts(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return best.select("doc_id", "pos", "sentence", "score")


@query("summary_texts_extracted", f"""
    with {_SENTENCES}
    select doc_id, string_agg(sentence, ' ' order by pos) as summary from best join sent using (doc_id, pos) group by 1""")
def summary_texts_extracted(spark, d):
    best = model.extract_summary(texts(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return model.summary_text(best, "doc_id")


@query("summary_success", """
    select count(*) filter (regexp_replace(coalesce(s, ''), '\\s', '', 'g') <> '' and not starts_with(s, 'Error')) as n_ok, count(*) as n
    from (select case doc_id % 4 when 0 then 'Error: none' when 1 then '  ' when 2 then null else text end as s from documents)""")
def summary_success(spark, d):
    kind = F.col("doc_id") % 4
    s = F.when(kind == 0, "Error: none").when(kind == 1, "  ").when(kind == 3, F.col("text"))
    return model.summary_success(table(spark, d, "documents").select(s.alias("s")), "s")


# ------------------------------------------------------------------ stream


@query("stream_unseen", r"""
    select distinct 'https://n.example/' || doc_id % 700 as url from documents
    where doc_id % 700 not in (select doc_id % 700 from documents where doc_id % 9 = 0)""")
def stream_unseen(spark, d):
    """Documents as a stream of items against a history of every ninth; some URLs repeat."""
    import uuid

    from newsflow.streaming.seen import stream_unseen as run

    root = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    url = F.concat(F.lit("https://n.example/"), (F.col("doc_id") % 700).cast("string"))
    docs = table(spark, d, "documents")
    seen = docs.filter("doc_id % 9 = 0").select(url.alias("initial_url")).distinct().select(
        "initial_url", F.lit("").alias("final_url"), F.lit("old").alias("title"), F.lit("old").alias("source"), F.lit(False).alias("isAI"),
        F.to_timestamp(F.lit("2024-01-01")).alias("created_at"))
    seen.write.mode("overwrite").parquet(f"{root}/history/version=0")
    # A pattern, as a stream takes no plain path of a single file; the table may be a file or a folder of them.
    stream = spark.readStream.schema(docs.schema).parquet(f"{d}/documents.parque[t]")
    published = F.to_timestamp(F.lit("2024-01-02")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("doc_id").cast("decimal(18,6)"))
    incoming = stream.select(
        F.col("doc_id").alias("id"), url.alias("url"), "source", F.col("doc_id").cast("string").alias("title"), F.lit(True).alias("isAI"),
        published.alias("published"))
    # A stream without rows writes nothing.
    seen.select(F.col("initial_url").alias("url")).limit(0).write.parquet(f"{root}/out/batch=-1")
    run(incoming, f"{root}/history", f"{root}/out", f"{root}/state").awaitTermination()
    # The batches are folders, whose number Spark may add as a column.
    return spark.read.schema("url string").parquet(f"{root}/out").select("url")
