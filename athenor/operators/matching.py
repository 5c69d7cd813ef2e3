"""Matching of titles and names, and predicates over text."""

from __future__ import annotations

import difflib
import re
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from athenor.functions.exprs import title_words, tokens
from athenor.operators.insights import METHOD_WORDS, has_any



def fuzzy_titles(left: DataFrame, right: DataFrame, threshold: float, rarest: int = 4) -> DataFrame:
    """(left_id, right_id, similarity): title pairs whose word sets have a Jaccard similarity of ``threshold`` or more.

    Prefix filter: words are ordered by how many titles have them, rarest first; sets of the threshold share one of the
    first (1 - threshold) n + 1 words, so only these are joined. ``rarest`` is the least number of words to join on.
    left(left_id, title), right(right_id, title).
    """
    a = left.select("left_id", F.array_distinct(title_words("title")).alias("wa"))
    b = right.select("right_id", F.array_distinct(title_words("title")).alias("wb"))
    counts = a.select(F.explode("wa").alias("w")).unionAll(b.select(F.explode("wb").alias("w"))).groupBy("w").agg(F.count("*").alias("n"))

    def prefix(df: DataFrame, key: str, words: str) -> DataFrame:
        each = df.select(key, F.size(words).alias("k"), F.explode(words).alias("w")).join(counts, "w")
        ordered = each.groupBy(key, "k").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("o"))  # the words of one title
        take = F.greatest(F.floor((1 - threshold) * F.col("k") + 1e-9).cast("int") + 1, F.least(F.lit(rarest), F.col("k")))
        return ordered.select(key, F.explode(F.slice("o", F.lit(1), take)).alias("s")).select(key, F.col("s.w").alias("w"))

    pairs = prefix(a, "left_id", "wa").join(prefix(b, "right_id", "wb"), "w").select("left_id", "right_id").distinct()
    both = pairs.join(a, "left_id").join(b, "right_id")
    shared = F.size(F.array_intersect("wa", "wb"))
    out = both.withColumn("similarity", shared / (F.size("wa") + F.size("wb") - shared))
    return out.where(F.col("similarity") >= threshold).select("left_id", "right_id", "similarity")


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of two lower-cased strings, which no built-in function gives."""
    return pd.Series([difflib.SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio() for x, y in zip(a, b, strict=True)])


def closest_names(names: DataFrame, known: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Best match of each name among ``known(known_name)`` that shares its first letter or a word; ratio of at least the threshold."""
    blocks = lambda c: F.array_distinct(F.concat(F.array(F.concat(F.lit("^"), F.substring(F.lower(c), 1, 1))), tokens(c)))
    left = names.select("name", F.explode(blocks("name")).alias("block"))
    right = known.select("known_name", F.explode(blocks("known_name")).alias("block"))
    pairs = left.join(right, "block").select("name", "known_name").distinct().withColumn("ratio", ratio("name", "known_name"))
    best = pairs.where(F.col("ratio") >= threshold).groupBy("name").agg(F.max(F.struct("ratio", "known_name")).alias("best"))
    return best.select("name", F.col("best.known_name").alias("known_name"), F.col("best.ratio").alias("ratio"))


def is_methodology(title: Column) -> Column:
    """A method word in the title. Methods venues and acronyms count only beside such a word, so they add nothing."""
    return has_any(title, METHOD_WORDS)


def input_type(text: Column) -> Column:
    """What a free input names: doi, openalex, arxiv, pmid, url or title."""
    t = F.trim(text)
    return (
        F.when(t.rlike(r"(?i)^(https?://(dx\.)?doi\.org/|doi:)?10\.\d{4,9}/\S+$"), "doi")
        .when(t.rlike(r"^(https?://openalex\.org/)?[WA]\d+$"), "openalex")
        .when(t.rlike(r"(?i)^(arxiv:)?\d{4}\.\d{4,5}(v\d+)?$"), "arxiv")
        .when(t.rlike(r"(?i)^(pmid:)?\d{5,9}$"), "pmid")
        .when(t.rlike(r"^https?://"), "url")
        .otherwise("title")
    )


def refined(text: Column, must: list[str], should: list[str], forbidden: list[str]) -> Column:
    """Boolean query: all of ``must``, one of ``should`` if there are any, none of ``forbidden``."""
    low = F.lower(F.coalesce(text, F.lit("")))
    ok = F.lit(True)
    for w in must:
        ok = ok & low.contains(w.lower())
    for w in forbidden:
        ok = ok & ~low.contains(w.lower())
    if should:
        some = F.lit(False)
        for w in should:
            some = some | low.contains(w.lower())
        ok = ok & some
    return ok


def resolve_fields(papers: DataFrame, fields: DataFrame, text: str, key: str, venue: str | None = None, authors: str | None = None) -> DataFrame:
    """(key, field, score, strategy): the field that fits each text best.

    Terms: 0.4 for the share of key concepts contained, 0.1 for that of include terms, 0.1 if the field's name or an alias is, less 0.15
    for each exclude term. 0.3 if one of ``authors`` (an array) is like a known leader (ratio over 0.8), 0.2 if ``venue`` is like
    a journal of the first tier (over 0.7), else 0.1 for the second. Of equal scores the last name wins; 0.1 or less is "ocean".
    The strategy is tier1_first from 0.8, balanced from 0.5, else broad.

    fields(field, key_concepts, include_terms, exclude_terms) is a small dimension of at most a thousand rows; the arrays aliases,
    known_leaders, tier1_journals and tier2_journals are optional.
    """
    if fields.count() > 1_000:
        raise ValueError("fields must be a small dimension")
    for name in ("aliases", "known_leaders", "tier1_journals", "tier2_journals"):
        if name not in fields.columns:
            fields = fields.withColumn(name, F.array().cast("array<string>"))
    held = lambda c: F.size(F.filter(c, lambda t: F.col("_low").contains(F.lower(t))))
    share = lambda c: held(c) / F.greatest(F.size(c), F.lit(1))
    pairs = papers.select(key, F.lower(F.coalesce(text, F.lit(""))).alias("_low")).crossJoin(F.broadcast(fields))  # checked above
    named = F.when(held(F.concat(F.array("field"), "aliases")) > 0, 0.1).otherwise(0.0)
    scored = pairs.select(key, "field", (0.4 * share(F.col("key_concepts")) + 0.1 * share(F.col("include_terms")) + named - 0.15 * held(F.col("exclude_terms"))).alias("score"))

    def alike(names: DataFrame, column: str, least: float, worth: float) -> DataFrame:
        """(name, field, worth) for names like one in the fields' array ``column``; each distinct name is compared once."""
        known = fields.select("field", F.explode(column).alias("_known"))
        close = names.crossJoin(F.broadcast(known)).where(ratio("name", "_known") > least)  # a column of the small dimension
        return close.select("name", "field").distinct().withColumn("worth", F.lit(worth))

    extra = []
    if authors:
        each = papers.select(key, F.explode(authors).alias("name"))
        extra.append(each.join(alike(each.select("name").distinct(), "known_leaders", 0.8, 0.3), "name").select(key, "field", "worth").distinct())
    if venue:
        each = papers.select(key, F.col(venue).alias("name")).where("name is not null")
        places = each.select("name").distinct()
        tiers = alike(places, "tier1_journals", 0.7, 0.2).unionByName(alike(places, "tier2_journals", 0.7, 0.1))
        extra.append(each.join(tiers.groupBy("name", "field").agg(F.max("worth").alias("worth")), "name").select(key, "field", "worth"))
    for more in extra:
        total = more.groupBy(key, "field").agg(F.max("worth").alias("worth"))
        scored = scored.join(total, [key, "field"], "left").select(key, "field", (F.col("score") + F.coalesce("worth", F.lit(0.0))).alias("score"))
    best = scored.groupBy(key).agg(F.max(F.struct("score", "field")).alias("b"))
    s = F.col("b.score")
    strategy = F.when(s >= 0.8, "tier1_first").when(s >= 0.5, "balanced").when(s > 0.1, "broad").otherwise("ocean")
    return best.select(key, F.when(s > 0.1, F.col("b.field")).otherwise("ocean").alias("field"), s.alias("score"), strategy.alias("strategy"))


def is_journal(venue: Column, journal: str, threshold: float = 0.8) -> Column:
    """Whether a venue is this journal: the same name, its name as whole words, or a ratio of the threshold or more.

    Names of up to eight letters, which other names contain, need a ratio of 0.9 as well.
    """
    low, name = F.lower(F.trim(venue)), journal.lower().strip()
    near = ratio(low, F.lit(name))
    worded = low.rlike(rf"\b{re.escape(name)}\b")
    return F.coalesce((F.lit(name) != "") & (low != "") & ((low == name) | F.when(worded, near >= 0.9 if len(name) <= 8 else F.lit(True)).otherwise(near >= threshold)), F.lit(False))


def venue_tiers(papers: DataFrame, first: list[str], second: list[str], threshold: float = 0.8) -> DataFrame:
    """(venue, tier) of each distinct venue: 1 or 2 if it is a journal of that list, else 3. Each venue is compared once."""
    hit = lambda names: reduce(or_, (is_journal(F.col("venue"), j, threshold) for j in names), F.lit(False))
    return papers.where("venue is not null").select("venue").distinct().withColumn("tier", F.when(hit(first), 1).when(hit(second), 2).otherwise(3))
