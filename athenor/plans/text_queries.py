"""Queries over texts, pages, events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from athenor.functions import exprs
from athenor.functions.storage import table
from athenor.operators import matching
from athenor.plans.adapter import sql, texts, works
from athenor.plans.registry import query
from athenor.sinks import exports
from athenor.sources import text_files

WORDS = "list_filter(regexp_extract_all(lower(abstract), '([\\p{L}\\p{N}_]+)', 1), lambda w: true)"


def _bm25(terms: list[str]) -> str:
    part = " + ".join(f"len(list_filter(w, lambda x: x = '{q}')) * 2.5 / (len(list_filter(w, lambda x: x = '{q}')) + 1.5 * (1 - 0.75 + 0.75 * len(w) / 200.0))" for q in terms)
    return f"least(1.0, ({part}) / {len(terms)})"


@query("bm25", sql(f"select id, round({_bm25(['the', 'ration', 'with'])}, 6) as score from (select id, {WORDS} as w from v_text) t"))
def bm25(spark, d):
    return texts(spark, d).select("id", F.round(exprs.bm25_like(F.col("abstract"), ["the", "ration", "with"]), 6).alias("score"))


@query(
    "keyword_match",
    sql("select id, round((contains(t, 'the')::int + contains(t, 'license')::int + contains(t, 'idiot')::int) / 3.0, 6) as score from (select id, lower(title || ' ' || abstract) as t from v_text) x"),
)
def keyword_match(spark, d):
    text = F.concat_ws(" ", "title", "abstract")
    return texts(spark, d).select("id", F.round(exprs.keyword_match(text, ["the", "license", "Idiot"]), 6).alias("score"))


@query(
    "basic_relevance",
    sql(
        """select id, round(least(1.0, case when contains(t, 'of the') then 0.6 else 0 end + 0.2 * (contains(t, 'of')::int + contains(t, 'the')::int) / 2.0
            + case when contains(a, 'of the') then 0.3 else 0.1 * (contains(a, 'of')::int + contains(a, 'the')::int) / 2.0 end + case when lower(venue) in ('of', 'the') then 0.1 else 0 end), 6) as score
        from (select id, lower(title) as t, lower(abstract) as a, venue from v_text) x"""
    ),
)
def basic_relevance(spark, d):
    return texts(spark, d).select("id", F.round(exprs.basic_relevance(F.col("title"), F.col("abstract"), F.array("venue"), "of the"), 6).alias("score"))


@query(
    "doi_extract",
    sql(
        """select page_id, list_distinct(list_transform(regexp_extract_all('see 10.1234/' || replace(url, '/', '.') || ', and doi:10.99999/X' || page_id || '; end', '(10\\.\\d{4,9}/[^\\s"<>\\]\\)]+)', 1),
            lambda x: regexp_replace(regexp_replace(lower(x), '^(https?://(dx\\.)?doi\\.org/)?(doi:)?\\s*', ''), '[.,;:]+$', ''))) as found from pages"""
    ).replace("select page_id, list_distinct(", "select page_id, array_to_string(list_sort(list_distinct(", 1).replace(") as found", ")), ' ') as found", 1),
)
def doi_extract(spark, d):
    text = F.concat(F.lit("see 10.1234/"), F.replace("url", F.lit("/"), F.lit(".")), F.lit(", and doi:10.99999/X"), F.col("page_id").cast("string"), F.lit("; end"))
    return table(spark, d, "pages").select("page_id", F.array_join(F.array_sort(text_files.dois_in(text)), " ").alias("found"))


@query("html_strip", "select page_id, length(regexp_replace(html, '<[^>]+>', '', 'g')) as n, md5(regexp_replace(html, '<[^>]+>', '', 'g')) as digest from pages")
def html_strip(spark, d):
    bare = exprs.strip_tags("html")
    return table(spark, d, "pages").select("page_id", F.length(bare).cast("bigint").alias("n"), F.md5(bare).alias("digest"))


@query(
    "input_types",
    sql(
        """select kind, count(*) as n from (select case work_id % 6 when 0 then 'doi' when 1 then 'openalex' when 2 then 'arxiv' when 3 then 'pmid' when 4 then 'url' else 'title' end as kind from v_work) t group by kind"""
    ),
)
def input_types(spark, d):
    w = works(spark, d)
    i = F.col("work_id").cast("string")
    kind = F.col("work_id") % 6
    text = (
        F.when(kind == 0, F.concat(F.lit("https://doi.org/10.1234/"), i)).when(kind == 1, F.concat(F.lit("W"), i)).when(kind == 2, F.concat(F.lit("arXiv:2101."), F.lpad(i, 5, "0")))
        .when(kind == 3, F.concat(F.lit("PMID:1"), F.lpad(i, 6, "0"))).when(kind == 4, F.concat(F.lit("https://example.org/"), i)).otherwise(F.col("title"))
    )
    return w.groupBy(matching.input_type(text).alias("kind")).agg(F.count("*").alias("n"))


METHOD = " or ".join(f"contains(lower(abstract), '{w}')" for w in matching.METHOD_WORDS)


@query(
    "methodology",
    sql(f"select venue, count(*) filter ({METHOD}) as methods, count(*) as documents from v_text group by venue"),
)
def methodology(spark, d):
    found = texts(spark, d).withColumn("m", matching.is_methodology(F.col("abstract")))
    return found.groupBy("venue").agg(F.count_if("m").alias("methods"), F.count("*").alias("documents"))


@query(
    "fuzzy_titles",
    """with t as (select item_id, list_distinct(list_filter(string_split_regex(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', '', 'g')), '\\s+'),
            lambda w: w <> '' and w not in ('a','an','and','by','for','from','in','of','on','the','to','with'))) as w from benchmark)
        select a.item_id as left_id, b.item_id as right_id, round(len(list_intersect(a.w, b.w)) * 1.0 / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) as similarity
        from t a, t b where len(list_intersect(a.w, b.w)) * 1.0 / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.3""",
)
def fuzzy_titles(spark, d):
    b = table(spark, d, "benchmark")
    left, right = (b.select(F.col("item_id").alias(c), F.col("text").alias("title")) for c in ("left_id", "right_id"))
    return matching.fuzzy_titles(left, right, 0.3).withColumn("similarity", F.round("similarity", 6))


@query("difflib_match")
def difflib_match(spark, d):
    names = works(spark, d).select(F.col("title").alias("name")).distinct()
    known = works(spark, d).select(F.concat("title", F.lit(" x")).alias("known_name")).distinct()
    return matching.closest_names(names, known, 0.8)


@query(
    "refined_query",
    sql("select venue, count(*) as documents from v_text where contains(lower(abstract), 'the') and not contains(lower(abstract), 'idiot') and (contains(lower(abstract), 'license') or contains(lower(abstract), 'with')) group by venue"),
)
def refined_query(spark, d):
    ok = matching.refined(F.col("abstract"), ["the"], ["license", "with"], ["idiot"])
    return texts(spark, d).where(ok).groupBy("venue").agg(F.count("*").alias("documents"))


@query(
    "event_props",
    "select user_id, event_type, count(*) as n, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) as total from events group by all",
)
def event_props(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@query(
    "event_windows",
    """select time_bucket(interval '1 day', ts) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by all""",
)
def event_windows(spark, d):
    e = table(spark, d, "events")
    grouped = e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


@query(
    "embedding_centroids",
    "select label, i, round(avg(x), 5) as mean from (select label, unnest(range(1, len(embedding) + 1)) as i, unnest(embedding)::double as x from embeddings) t group by all",
)
def embedding_centroids(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return e.groupBy("label", (F.col("i") + 1).cast("bigint").alias("i")).agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


@query(
    "turns",
    "select conv_id, turn, role, lag(role) over (partition by conv_id order by turn, role, text) as before, length(text) as n from conversations",
)
def turns(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"), F.length("text").cast("bigint").alias("n"))


@query(
    "export_graphml",
    sql("""select '<node id="' || work_id || '"><data key="label">' || replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</data></node>' as value from v_work union all
        select '<edge source="' || src || '" target="' || dst || '"><data key="weight">1.0</data></edge>' from v_ref"""),
)
def export_graphml(spark, d):
    from athenor.plans.adapter import references

    nodes = works(spark, d).select(F.col("work_id").alias("node"), F.col("title").alias("label"))
    edges = references(spark, d).select("src", "dst", F.lit(1.0).alias("weight"))
    return exports.graphml_rows(nodes, edges).where("part in (1, 2)").select("value")


#: Journals of the first two tiers; names as like as src1 and src11 count as one.
FIRST, SECOND = ["src1", "src5"], ["SRC-3", "src4"]


@query("venue_tiers")
def venue_tiers(spark, d):
    """Tier of every text by the similarity of its venue's name to the journals'."""
    t = texts(spark, d)
    tiers = matching.venue_tiers(t, FIRST, SECOND)
    return t.join(tiers, "venue", "left").groupBy("venue", F.coalesce("tier", F.lit(3)).alias("tier")).agg(F.count("*").alias("documents"))
