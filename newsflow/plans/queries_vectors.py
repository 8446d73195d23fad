"""Queries over vectors: near duplicates, diverse choice, clusters, tournaments."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsflow.operators import clustering, mmr, neardup, ranking, vectors
from newsflow.operators.numbering import number_rows
from newsflow.plans.registry import query, table
from newsflow.session import cut_lineage

_COPIES = """
    (select vec_id as id, embedding::double[] as v from embeddings
     union all select vec_id + 1000000, embedding::double[] from embeddings where vec_id % 10 = 0
     union all select vec_id + 2000000, embedding::double[] from embeddings where vec_id % 20 = 0)"""


def _with_copies(spark, d):
    """Vectors, some of them two or three times under other ids."""
    base = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    once = base.filter("id % 10 = 0").withColumn("id", F.col("id") + 1000000)
    twice = base.filter("id % 20 = 0").withColumn("id", F.col("id") + 2000000)
    return base.unionByName(once).unionByName(twice)


@query("unit_vectors", """
    select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm,
      round(embedding[1]::double / sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as first from embeddings""")
def unit_vectors(spark, d):
    df = table(spark, d, "embeddings").select("vec_id", "embedding", vectors.l2_normalise("embedding").alias("u"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return df.select("vec_id", F.round(norm, 6).alias("norm"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


@query("cosine_pairs", f"""
    with f as (select v, min(id) as vid from {_COPIES} group by 1)
    select a.vid as id_a, b.vid as id_b, round(list_cosine_similarity(a.v, b.v), 6) as sim from f a join f b on a.vid < b.vid
    where list_cosine_similarity(a.v, b.v) > 0.4
    union all select vid, id, 1.0 from {_COPIES} c join f on c.v = f.v where id <> vid""")
def cosine_pairs(spark, d):
    pairs = neardup.similar_pairs(_with_copies(spark, d), "id", "embedding", 0.4)
    return pairs.withColumn("sim", F.round("sim", 6))


_SIZED = f"(select id, v, case when id % 11 <> 3 then 100 + id % 5 end as len from {_COPIES})"


@query("neardup_drop", f"""
    with s as {_SIZED}
    select id, len as content_length from s x where not exists (
      select 1 from s y where y.id <> x.id and list_cosine_similarity(x.v, y.v) > 0.35
        and case when x.id < y.id then not coalesce(x.len > y.len, false) else coalesce(y.len > x.len, false) end)
    union all select page_id + 5000000, 1 from pages""")
def neardup_drop(spark, d):
    """Vectors with copies and missing lengths, and rows without a vector."""
    emb = _with_copies(spark, d)
    rows = emb.select("id", F.when(F.col("id") % 11 != 3, 100 + F.col("id") % 5).alias("content_length"))
    bare = table(spark, d, "pages").select((F.col("page_id") + 5000000).alias("id"), F.lit(1).cast("long").alias("content_length"))
    return neardup.drop_near_duplicates(rows.unionByName(bare), emb, threshold=0.35)


@query("neardup_losers", f"""
    with p as (select a.id as id_a, b.id as id_b from {_COPIES} a join {_COPIES} b on a.id < b.id where list_cosine_similarity(a.v, b.v) > 0.4)
    select distinct case when id_a % 7 > id_b % 7 then id_b else id_a end as id from p""")
def neardup_losers(spark, d):
    rows = _with_copies(spark, d).withColumn("len", F.col("id") % 7)
    return neardup.similar_losers(rows, "id", "embedding", "len", 0.4)


@query("dupe_marks_similar", f"""
    with p as (select a.id as id_a, b.id as id_b from {_COPIES} a join {_COPIES} b on a.id < b.id and a.id % 3 = b.id % 3 where list_cosine_similarity(a.v, b.v) > 0.3)
    select id, coalesce(m, -1) as dupe_id from {_COPIES} left join (select id_b, min(id_a) as m from p group by 1) on id_b = id""")
def dupe_marks_similar(spark, d):
    rows = _with_copies(spark, d).withColumn("cat", F.col("id") % 3)
    return neardup.similar_marks(rows, "id", "embedding", "cat", 0.3)


@query("neardup_documents", r"""
    with d as (select doc_id as id, text, n_chars as content_length from documents),
    w as (select id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) as term from d where length(trim(text)) > 0),
    tf as (select id, term, count(*) as c from w where term <> '' group by 1, 2),
    idf as (select term, ln(((select count(*) from d where length(trim(text)) > 0) + 1.0::double) / (count(*) + 1.0::double)) as idf from tf group by 1),
    x as (select id, term, c * idf as x from tf join idf using (term) where idf > 0),
    u as materialized (select id, term, x / sqrt(sum(x * x) over (partition by id)) as x from x),
    p as (select a.id as id_a, b.id as id_b from u a join u b on a.term = b.term and a.id < b.id group by 1, 2 having sum(a.x * b.x) > 0.925),
    l as (select case when a.content_length > b.content_length then id_b else id_a end as id from p join d a on a.id = id_a join d b on b.id = id_b)
    select id, content_length from d where id not in (from l)""")
def neardup_documents(spark, d):
    """Documents left after exact TF-IDF vectors of their texts are compared at 0.925."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("n_chars").alias("content_length"))
    return neardup.drop_near_texts(docs, threshold=0.925).drop("text")


_RATING = "(vec_id * 37 % 101) / 10.0"


def _mmr_sql(rows: str, steps: int) -> str:
    """Picks unrolled as one CTE per step."""
    parts = [
        f"e as materialized (select vec_id, embedding::double[] as v, {_RATING} as rating, "
        f"({_RATING} - lo) / (hi - lo) as rel from {rows}, (select min({_RATING}) as lo, max({_RATING}) as hi from {rows}))",
        "p0 as materialized (select vec_id, v from e order by rating desc, vec_id limit 1)",
        "s0 as materialized (select e.vec_id, e.v, rel, list_cosine_similarity(e.v, p0.v) as sim from e, p0 where e.vec_id <> p0.vec_id)",
    ]
    for i in range(1, steps):
        parts.append(f"p{i} as materialized (select vec_id, v from s{i-1} order by 0.5 * rel + 0.5 * (1 - sim) desc, vec_id limit 1)")
        parts.append(
            f"s{i} as materialized (select s.vec_id, s.v, rel, greatest(sim, list_cosine_similarity(s.v, p{i}.v)) as sim "
            f"from s{i-1} s, p{i} where s.vec_id <> p{i}.vec_id)")
    picks = " union all ".join(f"select {i} as pick, vec_id from p{i}" for i in range(steps))
    return f"with {', '.join(parts)}, picks as ({picks})"


def _rated_vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", ((F.col("vec_id") * 37 % 101) / 10.0).alias("rating"))


@query("mmr_topk", _mmr_sql("embeddings", 12) + " select vec_id, pick from picks")
def mmr_topk(spark, d):
    emb = table(spark, d, "embeddings").select("vec_id", "embedding")
    return mmr.mmr_select(_rated_vectors(spark, d), emb, 12, key="vec_id").select("vec_id", "pick")


@query("tiered_select", _mmr_sql(f"(select * from embeddings where {_RATING} <= 9.8)", 20) + f"""
    select vec_id from embeddings where {_RATING} > 9.8
    union all select vec_id from picks where pick < 20 - (select count(*) from embeddings where {_RATING} > 9.8)""")
def tiered_select(spark, d):
    emb = table(spark, d, "embeddings").select("vec_id", "embedding")
    return mmr.tiered_select(_rated_vectors(spark, d), emb, 20, 9.8, key="vec_id").select("vec_id")


@query("tiered_select_100")
def tiered_select_100(spark, d):
    """The usual size: everything above 8, filled up to 100."""
    emb = table(spark, d, "embeddings").select("vec_id", "embedding")
    return mmr.tiered_select(_rated_vectors(spark, d), emb, 250, 8.0, key="vec_id").select("vec_id", "rating")


# ------------------------------------------------------------------ clusters


@query("nearest_vectors", """
    select a.vec_id as vid, b.vec_id as other, round(list_distance(a.embedding::double[], b.embedding::double[]), 6) as dist
    from embeddings a join embeddings b on a.vec_id <> b.vec_id
    qualify row_number() over (partition by a.vec_id order by list_distance(a.embedding::double[], b.embedding::double[]), b.vec_id) <= 5""")
def nearest_vectors(spark, d):
    emb = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    near = clustering.nearest_neighbours(cut_lineage(vectors.merge_copies(emb, "vec_id", "embedding")), 5)
    return near.withColumn("dist", F.round("dist", 6))


@query("reduce_dimensions")
def reduce_dimensions(spark, d):
    out = clustering.reduce_dimensions(table(spark, d, "embeddings"), "vec_id", "embedding", 8)
    return out.select("vec_id", F.transform("embedding", lambda x: F.round(x, 4)).alias("reduced"))


def _hierarchy_sql(samples: str, sizes: str) -> str:
    """CTEs up to ``chosen`` (s, m, l, r, w): clusters as stretches of the order in which a spanning tree is grown.

    Rows up to a weight that belong together stand side by side in that order, so every node of the hierarchy is the longest stretch around
    a row whose connecting weights do not pass the row's.
    """
    return f"""with recursive
    e as materialized (select row_number() over (order by vec_id)::int as i, vec_id, embedding::double[] as v from embeddings),
    ss as (select unnest({samples})::int as s), ms as (select unnest({sizes})::int as m),
    d as materialized (select a.i, b.i as j, round(list_distance(a.v, b.v), 9) as d from e a join e b on a.i <> b.i),
    near as (select i, d, row_number() over (partition by i order by d) + 1 as k from d),
    core as materialized (select s, i, case when s = 1 then 0 else d end as core from ss join near on k = greatest(s, 2)),
    reach as materialized (select a.s, d.i, d.j, greatest(d.d, a.core, b.core) as w from d join core a on a.i = d.i join core b on b.i = d.j and b.s = a.s),
    lists as materialized (select s, i, list(w order by j) as w from (select s, i, j, w from reach union all select s, i, i, 'infinity' from core) group by 1, 2),
    grown as (
      select s, 1 as k, 1 as i, 'infinity'::double as w, list_transform(w, lambda x, j: case when j = 1 then null else x end) as left_ from lists where i = 1
      union all
      select g.s, k + 1, g.next_::int, g.low, list_transform(left_, lambda x, j: case when x is null or j = g.next_ then null else least(x, l.w[j]) end)
      from (select *, list_min(left_) as low, list_position(left_, list_min(left_)) as next_ from grown where list_min(left_) is not null) g join lists l on l.s = g.s and l.i = g.next_),
    o as materialized (select s, k, i, w from grown),
    nodes as materialized (
      select distinct s, l, r, w, r - l as size from (
        select o.s, o.k, any_value(o.w) as w, max(p.k) filter (p.k < o.k) as l, coalesce(min(p.k) filter (p.k > o.k), (select max(k) + 1 from o)) as r
        from o join o p on p.s = o.s and p.w > o.w where o.k > 1 group by 1, 2)),
    big as materialized (select m, n.* from nodes n join ms on size >= m),
    up as materialized (
      select b.s, b.m, b.l, b.r, b.size, b.w, p.l as pl, p.r as pr, p.w as pw from big b left join big p on p.s = b.s and p.m = b.m and p.l <= b.l and p.r >= b.r and p.size > b.size
      qualify row_number() over (partition by b.s, b.m, b.l, b.r order by p.size) = 1),
    parts as materialized (select s, m, pl as l, pr as r, count(*) as n_big, sum(size) as in_big from up where pl is not null group by all),
    heads as materialized (
      select up.s, up.m, up.l, up.r, up.size, up.pl, up.pr, case when pl is null then 0 else 1 / greatest(pw, 1e-12) end as birth
      from up left join parts p on p.s = up.s and p.m = up.m and p.l = pl and p.r = pr where pl is null or n_big >= 2),
    owned as materialized (
      select up.s, up.m, up.l, up.r, up.size, up.w, h.l as hl, h.r as hr, h.birth from up join heads h on h.s = up.s and h.m = up.m and h.l <= up.l and h.r >= up.r
      qualify row_number() over (partition by up.s, up.m, up.l, up.r order by h.size) = 1),
    mass as materialized (
      select o.s, o.m, hl as l, hr as r, sum((size - case when n_big = 1 then in_big else 0 end) * (1 / greatest(w, 1e-12) - birth)) as mass
      from owned o left join parts p on p.s = o.s and p.m = o.m and p.l = o.l and p.r = o.r group by all),
    tree as materialized (
      select h.s, h.m, h.l, h.r, h.size, h.pl is null as root, mass, o.hl, o.hr, row_number() over (partition by h.s, h.m order by h.size, h.l) as q
      from heads h join mass x on x.s = h.s and x.m = h.m and x.l = h.l and x.r = h.r left join owned o on o.s = h.s and o.m = h.m and o.l = h.pl and o.r = h.pr),
    kids as materialized (select t.*, coalesce((select list(c.q) from tree c where c.s = t.s and c.m = t.m and c.hl = t.l and c.hr = t.r), []) as kids from tree t),
    best as (
      select s, m, 0 as q, []::double[] as best, false as takes from (select distinct s, m from tree)
      union all
      select k.s, k.m, k.q::int, list_append(b.best, case when not root and mass >= coalesce(list_sum(list_transform(kids, lambda c: b.best[c])), 0) then mass
        else coalesce(list_sum(list_transform(kids, lambda c: b.best[c])), 0) end), not root and mass >= coalesce(list_sum(list_transform(kids, lambda c: b.best[c])), 0)
      from best b join kids k on k.s = b.s and k.m = b.m and k.q = b.q + 1),
    taken as materialized (select t.* from tree t join best b on b.s = t.s and b.m = t.m and b.q = t.q where takes),
    chosen as materialized (select s, m, l, r from taken t where not exists (select 1 from taken u where u.s = t.s and u.m = t.m and u.l <= t.l and u.r >= t.r and u.size > t.size))"""


@query("cluster_density", _hierarchy_sql("[3]", "[5]") + """,
    found as (select c.l, e.vec_id from chosen c join o on o.k >= c.l and o.k < c.r join e on e.i = o.i),
    numbers as (select l, row_number() over (order by min(vec_id)) - 1 as cluster from found group by 1)
    select e.vec_id, coalesce(cluster, -1)::int as cluster from e left join (select vec_id, cluster from found join numbers using (l)) using (vec_id)""")
def cluster_density(spark, d):
    return clustering.density_clusters(table(spark, d, "embeddings"), "vec_id", "embedding", 5, 3)


@query("cluster_search", _hierarchy_sql("range(1, 11)", "range(2, 11)") + """,
    grid as (select s, m from ss join ms on s <= m),
    label as materialized (select g.s, g.m, e.i, c.l from grid g join o on o.s = g.s join e on e.i = o.i left join chosen c on c.s = g.s and c.m = g.m and o.k >= c.l and o.k < c.r),
    told as materialized (select s, m, count(distinct l) as n_clusters, avg((l is null)::int) as noise_ratio, count(*) as total from label group by 1, 2),
    used as materialized (select label.* from label join told using (s, m) where l is not null and n_clusters >= 2 and noise_ratio <= 0.8),
    sizes as materialized (select s, m, l, count(*) as n from used group by all),
    sums as materialized (
      select a.s, a.m, a.i, a.l as own, b.l as other, sum(list_distance(x.v, y.v)) as d from used a join used b on b.s = a.s and b.m = a.m and b.i <> a.i
      join e x on x.i = a.i join e y on y.i = b.i group by all),
    sil as (
      select s, m, avg(case when a is null or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end) as sil from (
        select t.s, t.m, t.i, max(d / (n - 1)) filter (own = other and n > 1) as a, min(d / n) filter (own <> other) as b
        from sums t join sizes z on z.s = t.s and z.m = t.m and z.l = other group by 1, 2, 3) group by 1, 2),
    apart as (select a.s, a.m, a.l, min(w) as apart from used a join used b on b.s = a.s and b.m = a.m and b.l <> a.l join reach on reach.s = a.s and reach.i = a.i and reach.j = b.i group by all),
    sparse as (select c.s, c.m, c.l, max(w) as sparse from chosen c join o on o.s = c.s and o.k > c.l and o.k < c.r group by all),
    val as (
      select s, m, sum(n / total * case when greatest(apart, sparse) = 0 then 0 else (apart - sparse) / greatest(apart, sparse) end) as val
      from sizes join apart using (s, m, l) join sparse using (s, m, l) join told using (s, m) group by 1, 2)
    select m as min_cluster_size, s as min_samples, n_clusters, round(noise_ratio, 6) as noise_ratio, round(case when n_clusters < 2 or noise_ratio > 0.8 then -1 else 0.5 * greatest(sil, 0) + 0.5 * greatest(coalesce(val, 0), 0) end, 6) as score
    from told left join sil using (s, m) left join val using (s, m)""")
def cluster_search(spark, d):
    """The whole grid: sizes 2 to 10, every min_samples up to the size."""
    out = clustering.search_parameters(table(spark, d, "embeddings"), "vec_id", "embedding")
    return out.withColumns({c: F.round(c, 6) for c in ("noise_ratio", "score")})


_CENTRES = """
    e as (select vec_id, label, embedding::double[] as v from embeddings where label > 0),
    dims as (select label, generate_subscripts(v, 1) as i, unnest(v) as x from e),
    cd as (select label, i, avg(x) as m from dims group by 1, 2),
    c as (select label, list(m order by i) as centre from cd group by 1),
    g as (select list(m order by i) as middle from (select i, avg(x) as m from dims group by 1)),
    w as (select label, count(*) as n, sum(list_distance(v, centre) ** 2) as w, avg(list_distance(v, centre)) as s from e join c using (label) group by 1)"""


@query("cluster_metrics", f"""
    with {_CENTRES},
    r as (select a.label, max((wa.s + wb.s) / list_distance(a.centre, b.centre)) as r from c a join c b on a.label <> b.label
          join w wa on wa.label = a.label join w wb on wb.label = b.label group by 1)
    select count(*) as n_clusters,
      round((sum(n * list_distance(centre, middle) ** 2) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 6) as calinski_harabasz,
      round((select avg(r) from r), 6) as davies_bouldin
    from c join w using (label), g""")
def cluster_metrics(spark, d):
    """Label 0 stands for noise."""
    out = clustering.centroid_metrics(table(spark, d, "embeddings"), "label", "embedding", noise=0)
    return out.withColumns({c: F.round(c, 6) for c in ("calinski_harabasz", "davies_bouldin")})


@query("cluster_silhouette", """
    with e as (select vec_id, label, embedding::double[] as v from embeddings where label > 0),
    n as (select label, count(*) as n from e group by 1),
    m as (select a.vec_id, a.label as own, b.label as other, sum(list_distance(a.v, b.v)) as d from e a join e b on a.vec_id <> b.vec_id group by 1, 2, 3),
    s as (select vec_id, max(d / (n - 1)) filter (own = other and n > 1) as a, min(d / n) filter (own <> other) as b from m join n on n.label = other group by 1)
    select round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) as silhouette from s""")
def cluster_silhouette(spark, d):
    out = clustering.silhouette(table(spark, d, "embeddings"), "vec_id", "label", "embedding", noise=0)
    return out.withColumn("silhouette", F.round("silhouette", 6))


@query("cluster_validity", """
    with recursive
    e as materialized (select row_number() over (partition by label order by vec_id)::int as i, label, vec_id, embedding::double[] as v from embeddings where label > 0),
    d as materialized (select a.label as la, a.i as ia, b.label as lb, b.i as ib, round(list_distance(a.v, b.v), 9) as d from e a join e b on a.vec_id <> b.vec_id),
    c as materialized (select la as label, ia as i, d as core from d qualify row_number() over (partition by la, ia order by d) = 4),
    w as materialized (select la, ia, lb, ib, greatest(d, x.core, y.core) as w from d join c x on x.label = la and x.i = ia join c y on y.label = lb and y.i = ib),
    lists as materialized (select label, i, list(w order by j) as w from (select la as label, ia as i, ib as j, w from w where la = lb union all select label, i, i, 'infinity' from c) group by 1, 2),
    grown as (
      select label, 0.0::double as w, list_transform(w, lambda x, j: case when j = 1 then null else x end) as left_ from lists where i = 1
      union all
      select g.label, g.low, list_transform(left_, lambda x, j: case when x is null or j = g.next_ then null else least(x, l.w[j]) end)
      from (select *, list_min(left_) as low, list_position(left_, list_min(left_)) as next_ from grown where list_min(left_) is not null) g join lists l on l.label = g.label and l.i = g.next_),
    sparse as (select label, max(w) as sparse from grown group by 1),
    apart as (select la as label, min(w) as apart from w where la <> lb group by 1),
    n as (select label, count(*) as n from e group by 1)
    select round(sum(n * (apart - sparse) / greatest(apart, sparse)) / (select count(*) from embeddings), 6) as validity from n join sparse using (label) join apart using (label)""")
def cluster_validity(spark, d):
    out = clustering.validity(table(spark, d, "embeddings"), "vec_id", "label", "embedding", noise=0)
    return out.withColumn("validity", F.round("validity", 6))


@query("composite_score", """
    select event_id, case when event_id % 4 > 0 then round(0.5 * greatest(value / 100 - 0.2, 0) + 0.5 * greatest(coalesce(case when event_id % 3 > 0 then 0.5 - value / 50 end, 0), 0), 6) end as score from events""")
def composite_score(spark, d):
    s = F.when(F.col("event_id") % 4 > 0, F.col("value") / 100 - 0.2)
    v = F.when(F.col("event_id") % 3 > 0, 0.5 - F.col("value") / 50)
    return table(spark, d, "events").select("event_id", F.round(clustering.composite_score(s, v), 6).alias("score"))


@query("cluster_names", """
    with e as (select label - 1 as cluster, 't' || (vec_id * 7 % 13) as topic from embeddings),
    c as (select cluster, topic, count(*) as c from e group by 1, 2),
    b as (select cluster, topic from c qualify row_number() over (partition by cluster order by c desc, topic) = 1)
    select cluster, count(*) as n, case when count(*) < 2 or cluster = -1 then 'Other' else any_value(b.topic) end as name
    from e join b using (cluster) group by 1""")
def cluster_names(spark, d):
    topic = F.concat(F.lit("t"), (F.col("vec_id") * 7 % 13).cast("string"))
    rows = table(spark, d, "embeddings").select((F.col("label") - 1).alias("cluster"), F.array(topic).alias("topics"))
    return clustering.name_clusters(rows, "cluster", "topics")


@query("noise_last", """
    select vec_id, case when label = 0 then 999 else label - 1 end as cluster, row_number() over (order by case when label = 0 then 999 else label - 1 end, vec_id) as place from embeddings""")
def noise_last(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", (F.col("label") - 1).alias("cluster"))
    return number_rows(clustering.noise_last(rows), ["cluster", "vec_id"], "place")


@query("neighbour_order")
def neighbour_order(spark, d):
    return clustering.neighbour_order(table(spark, d, "embeddings"), "vec_id", "label", "embedding")


# ------------------------------------------------------------------ tournaments

_PLACED = """
    (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_partkey, l_suppkey) as place from lineitem)"""


def _placed(spark, d):
    from pyspark.sql import Window

    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    # An order is a batch of a few lines.
    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_suppkey")
    return lines.select("l_orderkey", F.col("l_partkey").alias("id"), F.row_number().over(order).alias("place"))


@query("battle_pairs", f"""
    select a.l_orderkey, a.l_partkey as winner, b.l_partkey as loser from {_PLACED} a join {_PLACED} b on a.l_orderkey = b.l_orderkey and a.place < b.place""")
def battle_pairs(spark, d):
    return ranking.battle_results(_placed(spark, d), ["l_orderkey"])


@query("battle_wins", f"""
    select a.l_partkey as id, count(*) as wins from {_PLACED} a join {_PLACED} b on a.l_orderkey = b.l_orderkey and a.place < b.place group by 1""")
def battle_wins(spark, d):
    battles = ranking.battle_results(_placed(spark, d), ["l_orderkey"])
    return battles.groupBy(F.col("winner").alias("id")).agg(F.count(F.lit(1)).alias("wins"))


def _bt_sql(iterations: int) -> str:
    parts = [
        f"pl as materialized {_PLACED}",
        "k as materialized (select a.l_partkey as w, b.l_partkey as l from pl a join pl b on a.l_orderkey = b.l_orderkey and a.place < b.place where a.l_partkey <> b.l_partkey)",
        "m as materialized (select least(w, l) as a, greatest(w, l) as b, count(*) as n from k group by 1, 2)",
        "p as materialized (select a as i, b as j, n from m union all select b, a, n from m)",
        "won as materialized (select p_partkey as i, coalesce(wins, 0) as wins from part left join (select w, count(*) as wins from k group by 1) on w = p_partkey)",
        "s0 as (select i, 1.0::double as w from won)",
    ]
    for t in range(iterations):
        parts.append(
            f"s{t+1} as materialized (select won.i, (wins + 0.05) / (coalesce(d, 0) + 0.1 / (s.w + 1)) as w from won join s{t} s on s.i = won.i "
            f"left join (select p.i, sum(n / (x.w + y.w)) as d from p join s{t} x on x.i = p.i join s{t} y on y.i = p.j group by 1) q on q.i = won.i)")
    return f"with {', '.join(parts)} select i as p_partkey, round(ln(w) - (select avg(ln(w)) from s{iterations}), 5) as bt from s{iterations}"


@query("bradley_terry", _bt_sql(10))
def bradley_terry(spark, d):
    """Parts ranked by the orders they share, ten iterations."""
    battles = ranking.battle_results(_placed(spark, d), ["l_orderkey"])
    parts = table(spark, d, "part").select("p_partkey")
    fitted = ranking.bradley_terry(parts, battles, "p_partkey", iterations=10)
    return fitted.withColumn("bt", F.round("bt", 5))


@query("swiss_pairs", """
    with r as (select c_custkey as id, row_number() over (order by c_acctbal desc, c_custkey) as n from customer)
    select a.id as a, b.id as b from r a join r b on b.n = a.n + 1 where a.n % 2 = 1""")
def swiss_pairs(spark, d):
    """First-round pairs of all customers by balance, paired in windows of 77 that hand their last item on."""
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    ranked = ranking.rank_windows(customers, "id", "c_acctbal", 77).withColumn("fought", F.array().cast("array<long>"))
    return ranking.swiss_pairs(ranked).select("a", "b")


@query("tournament")
def tournament(spark, d):
    """Customers ranked by balance, three rounds."""
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    out = ranking.tournament(
        customers.select("id"), lambda seated: ranking.judge_by_score(seated, customers, "id", "c_acctbal"), rounds=3, iterations=10)
    return out.select("id", F.round("bt", 5).alias("bt"), F.round("bt_z", 5).alias("bt_z"))
