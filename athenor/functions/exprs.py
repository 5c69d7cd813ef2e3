"""Column functions: pure expressions, no actions, no Python on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from athenor.params import DEFAULT, STOP_WORDS, Params


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- identifiers and text ------------------------------------------------------------------------------------------


def normalize_doi(doi: Column | str) -> Column:
    """Lower case without resolver prefix, ``doi:`` and trailing marks."""
    bare = F.regexp_replace(F.lower(F.trim(col(doi))), r"^(https?://(dx\.)?doi\.org/)?(doi:)?\s*", "")
    return F.regexp_replace(bare, r"[.,;:]+$", "")


def canonical_id(doi: Column, openalex: Column, s2: Column, pmid: Column, internal: Column) -> Column:
    """First non-empty id with its prefix: doi, openalex, s2, pmid, internal."""
    named = [("doi:", normalize_doi(doi)), ("openalex:", openalex), ("s2:", s2), ("pmid:", pmid), ("internal:", internal)]
    return F.coalesce(*(F.concat(F.lit(p), F.nullif(F.trim(c.cast("string")), F.lit(""))) for p, c in named))


def title_words(title: Column | str) -> Column:
    """Words of the lower-cased title without marks and stop words."""
    bare = F.regexp_replace(F.lower(F.coalesce(col(title), F.lit(""))), r"[^\p{L}\p{N}_\s]", "")
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(F.split(F.trim(bare), r"\s+"), lambda w: (w != "") & ~F.array_contains(stop, w))


def title_hash(title: Column | str) -> Column:
    """The first ten title words in alphabetical order."""
    return F.array_join(F.array_sort(F.slice(title_words(title), 1, 10)), " ")


def tokens(text: Column | str) -> Column:
    """Words of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def canonical_term(term: Column | str) -> Column:
    """Lower case; a final s goes if more than four letters are there."""
    low = F.lower(F.trim(col(term)))
    return F.when((F.length(low) > 4) & low.endswith("s"), F.substring(low, F.lit(1), F.length(low) - 1)).otherwise(low)


def normalize_name(name: Column | str) -> Column:
    """Lower case, marks out, single letters (initials) out."""
    bare = F.regexp_replace(F.lower(F.coalesce(col(name), F.lit(""))), r"[^\p{L}\s]", " ")
    return F.array_join(F.filter(F.split(F.trim(bare), r"\s+"), lambda w: F.length(w) > 1), " ")


def names_similar(a: Column | str, b: Column | str) -> Column:
    """Same last name and same first initial."""
    first, second = (F.split(F.trim(F.lower(col(x))), r"\s+") for x in (a, b))
    return (F.element_at(first, -1) == F.element_at(second, -1)) & (F.substring(F.element_at(first, 1), 1, 1) == F.substring(F.element_at(second, 1), 1, 1))


def specific_tokens(text: Column | str) -> Column:
    """One for each capitalised word, half for each long word or word with a digit; cut to a whole number."""
    words = F.filter(F.split(F.coalesce(col(text), F.lit("")), r"\s+"), lambda w: w != "")
    worth = F.aggregate(
        words, F.lit(0.0), lambda acc, w: acc + F.when(w.rlike(r"^\p{Lu}"), 1.0).when((F.length(w) > 8) | w.rlike(r"\d"), 0.5).otherwise(0.0)
    )
    return F.floor(worth).cast("int")


def jaccard(a: Column | str, b: Column | str) -> Column:
    """|a and b| / |a or b| of two arrays, 0 if both are empty."""
    union = F.size(F.array_union(col(a), col(b)))
    return F.when(union > 0, F.size(F.array_intersect(col(a), col(b))) / union).otherwise(F.lit(0.0))


def year_in(text: Column | str) -> Column:
    """First year from 1900 to 2099 in a text."""
    return F.expr(f"try_cast(nullif(regexp_extract({text if isinstance(text, str) else 'text'}, '(19|20)[0-9]{{2}}', 0), '') as int)")


def strip_tags(html: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(col(html), F.lit("")), r"<[^>]+>", "")


def looks_like_review(title: Column | str, kind: Column | str | None = None) -> Column:
    """"review" in the first fifty characters of the title, or the type itself."""
    found = F.lower(F.substring(F.coalesce(col(title), F.lit("")), 1, 50)).contains("review")
    return found if kind is None else found | (F.coalesce(col(kind), F.lit("")) == "review")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


# ---- scores --------------------------------------------------------------------------------------------------------


def recency_impact(year: Column | str, citations: Column | str, p: Params = DEFAULT) -> Column:
    """Half for youth over ten years, half for the logarithm of the citations."""
    recency = F.when(col(year).isNotNull(), F.greatest(F.lit(0.0), 1 - (F.lit(p.as_of_year) - col(year)) / 10)).otherwise(0.0)
    return 0.5 * recency + 0.5 * F.least(F.log10(F.coalesce(col(citations), F.lit(0)) + 1) / 4, F.lit(1.0))


def collaboration_strength(papers: Column | str, span: Column | str, ago: Column | str) -> Column:
    return (2 * F.log1p(col(papers)) + F.log1p(col(span))) * (0.5 + 0.5 / (1 + 0.2 * col(ago)))


def gap_score(a: Column | str, b: Column | str, similarity: Column | str) -> Column:
    return F.least(F.lit(1.0), F.log1p(F.sqrt(col(a) * col(b))) / 5 * (1 - col(similarity)))


def priority(relevance: Column, novelty: Column, recency: Column, citations: Column, depth: Column) -> Column:
    impact = F.least(F.log10(F.coalesce(citations, F.lit(0)) + 1) / 4, F.lit(1.0))
    return (0.4 * relevance + 0.15 * novelty + 0.25 * recency + 0.2 * impact) / (1 + 0.3 * depth)


def proximity(distance: Column | str, depth: Column | str | None = None, p: Params = DEFAULT) -> Column:
    """exp(-alpha d); without a way the depth, or 3, stands in."""
    stand_in = F.lit(3) if depth is None else F.when(col(depth) > 0, col(depth)).otherwise(3)
    return F.exp(-p.proximity_alpha * F.coalesce(col(distance), stand_in))


def multipath(paths: Column | str, p: Params = DEFAULT) -> Column:
    return F.least(F.lit(1.0), F.log1p(F.least(col(paths), F.lit(p.max_paths))) / F.log(F.lit(float(p.max_paths))))


def intro_count(n: Column | str, p: Params = DEFAULT) -> Column:
    """How many leading references count as introduction: a quarter, ten at least where there are ten, twenty at most."""
    quarter = F.floor(col(n) * p.intro_share)
    return F.least(F.when(col(n) >= 10, F.greatest(quarter, F.lit(10))).otherwise(quarter), F.lit(40), F.lit(p.intro_most)).cast("int")


def intro_count_plain(n: Column | str, p: Params = DEFAULT) -> Column:
    """The older rule: all references where there are fewer than ten."""
    return F.when(col(n) >= 10, F.greatest(F.least(F.floor(col(n) * p.intro_share), F.lit(p.intro_most)), F.lit(10))).otherwise(col(n)).cast("int")


def hub_type(citations: Column | str, relevance: Column | str, known: Column | None = None, p: Params = DEFAULT) -> Column:
    mega = col(citations) >= p.mega_citations
    return (
        F.when(mega if known is None else known | mega, "mega")
        .when((col(citations) >= p.hub_citations) & (col(relevance) < p.hub_relevance), "suppressed")
        .when(col(citations) >= p.hub_citations, "hub")
        .otherwise("none")
    )


def hub_limits(kind: Column | str) -> Column:
    """Most references, citations and authors to follow."""
    make = lambda a, b, c: F.struct(F.lit(a).alias("refs"), F.lit(b).alias("cites"), F.lit(c).alias("authors"))
    return F.when(col(kind) == "mega", make(0, 0, 0)).when(col(kind) == "suppressed", make(10, 5, 0)).when(col(kind) == "hub", make(25, 15, 10)).otherwise(make(50, 30, 20))


def hub_penalty(kind: Column | str) -> Column:
    return F.when(col(kind) == "mega", 0.1).when(col(kind) == "suppressed", 0.3).when(col(kind) == "hub", 0.7).otherwise(1.0)


def relevance_gate(relevance: Column, is_intro: Column, citations: Column, p: Params = DEFAULT) -> Column:
    """Edge type that a reference earns, or null: introduction from 0.20, others from 0.15; hubs are weakened."""
    hub = (citations >= p.mega_citations) & (relevance < p.hub_relevance)
    passes = F.when(is_intro, relevance >= 0.20).otherwise(relevance >= 0.15)
    return F.when(hub & (relevance >= 0.15), "CITES").when(~hub & passes, F.when(is_intro, "INTRO_HINT_CITES").otherwise("CITES"))


def keyword_match(text: Column, keywords: list[str]) -> Column:
    """Share of the keywords that the lower-cased text contains."""
    if not keywords:
        return F.lit(0.0)
    hits = [F.lower(text).contains(k.lower()).cast("int") for k in keywords]
    return sum(hits[1:], hits[0]) / len(keywords)


def bm25_like(text: Column, query: list[str], k1: float = 1.5, b: float = 0.75, average: float = 200.0) -> Column:
    """Term saturation without inverse document frequency, divided by the query's length, 1 at most."""
    words = tokens(text)
    length = F.size(words)
    total = F.lit(0.0)
    for q in query:
        tf = (F.size(words) - F.size(F.array_remove(words, q))).cast("double")
        total = total + tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))
    return F.least(F.lit(1.0), total / len(query)) if query else F.lit(0.0)


def basic_relevance(title: Column, abstract: Column, concepts: Column, topic: str) -> Column:
    """Phrase in the title, share of topic words in title and abstract, and topic words among the concepts."""
    words = [w for w in topic.lower().split() if w]
    if not words:
        return F.lit(0.5)
    low, low_abstract = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(abstract, F.lit("")))
    share = lambda text: sum((text.contains(w).cast("int") for w in words), F.lit(0)) / len(words)
    phrase = F.when(low.contains(topic.lower()), 0.6).otherwise(0.0)
    body = F.when(low_abstract.contains(topic.lower()), 0.3).otherwise(0.1 * share(low_abstract))
    concept = F.when(F.exists(concepts, lambda c: F.lower(c).isin(words)), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), phrase + 0.2 * share(low) + body + concept)
