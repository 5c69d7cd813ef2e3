"""Records of further bibliographic services, in JSON or XML columns, as papers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from athenor.functions.exprs import looks_like_review, normalize_doi, strip_tags

S2 = "paperId string, title string, year int, venue string, abstract string, citationCount bigint, referenceCount bigint, publicationTypes array<string>, externalIds struct<DOI:string,PubMed:string>, authors array<struct<authorId:string,name:string>>"
CROSSREF = (
    "DOI string, title array<string>, type string, abstract string, `container-title` array<string>, `is-referenced-by-count` bigint, `references-count` bigint, "
    "author array<struct<given:string,family:string>>, issued struct<`date-parts`:array<array<int>>>, `published-print` struct<`date-parts`:array<array<int>>>"
)
PUBMED = (
    "MedlineCitation struct<PMID:string, Article:struct<ArticleTitle:string, Journal:struct<Title:string, JournalIssue:struct<PubDate:struct<Year:int, MedlineDate:string>>>, "
    "Abstract:struct<AbstractText:array<string>>, AuthorList:struct<Author:array<struct<LastName:string, ForeName:string>>>, PublicationTypeList:struct<PublicationType:array<string>>>>"
)
ORCID = (
    "`orcid-identifier` struct<path:string>, person struct<name:struct<`given-names`:struct<value:string>,`family-name`:struct<value:string>>>, "
    "employments array<struct<organization:string,role:string,start_year:int,end_year:int>>, works array<struct<title:string,type:string,year:int,doi:string>>"
)

AUTHOR = (
    "id string, orcid string, display_name string, display_name_alternatives array<string>, works_count bigint, cited_by_count bigint, summary_stats struct<h_index:int>, "
    "last_known_institutions array<struct<display_name:string>>, x_concepts array<struct<display_name:string,score:double>>"
)
ORCID_MORE = "educations array<struct<organization:string,role:string,start_year:int,end_year:int>>, fundings array<struct<title:string,organization:string,year:int>>"

#: Names of work types.
WORK_TYPES = {"journal-article": "article", "conference-paper": "proceedings", "book-chapter": "chapter", "preprint": "preprint", "dissertation-thesis": "thesis"}


def parse_semantic(raw: DataFrame, column: str) -> DataFrame:
    w = raw.select(F.from_json(column, S2).alias("w")).select("w.*").where("paperId is not null")
    kinds = F.coalesce(F.col("publicationTypes"), F.array().cast("array<string>"))
    return w.select(
        F.col("paperId").alias("s2_id"), normalize_doi(F.col("externalIds.DOI")).alias("doi"), F.col("externalIds.PubMed").alias("pmid"), "title", "year", "venue", "abstract",
        F.coalesce("citationCount", F.lit(0)).alias("citation_count"), F.coalesce("referenceCount", F.lit(0)).alias("reference_count"),
        F.slice(F.transform("authors", lambda a: a["name"]), 1, 10).alias("authors"), F.slice(F.transform("authors", lambda a: a["authorId"]), 1, 10).alias("author_ids"),
        (F.array_contains(kinds, "Review") | looks_like_review("title")).alias("is_review"),
    )


def parse_crossref(raw: DataFrame, column: str) -> DataFrame:
    """Tags go from the abstract; the year is that of issue, else of print."""
    w = raw.select(F.from_json(column, CROSSREF).alias("w")).select("w.*").where("DOI is not null")
    year = F.coalesce(F.get(F.get(F.col("issued.`date-parts`"), 0), 0), F.get(F.get(F.col("`published-print`.`date-parts`"), 0), 0))
    title = F.get("title", 0)
    return w.select(
        normalize_doi("DOI").alias("doi"), title.alias("title"), year.alias("year"), F.get("`container-title`", 0).alias("venue"), F.nullif(F.trim(strip_tags("abstract")), F.lit("")).alias("abstract"),
        F.coalesce("`is-referenced-by-count`", F.lit(0)).alias("citation_count"), F.coalesce("`references-count`", F.lit(0)).alias("reference_count"),
        F.slice(F.transform("author", lambda a: F.concat_ws(" ", a["given"], a["family"])), 1, 10).alias("authors"), looks_like_review(title, "type").alias("is_review"),
    )


def parse_pubmed(raw: DataFrame, column: str) -> DataFrame:
    """One article element in each row; the parts of the abstract are joined."""
    w = raw.select(F.from_xml(column, PUBMED).alias("w")).select("w.MedlineCitation.*").where("PMID is not null")
    date = F.col("Article.Journal.JournalIssue.PubDate")
    year = F.coalesce(date["Year"], F.regexp_extract(date["MedlineDate"], r"(\d{4})", 1).try_cast("int"))
    return w.select(
        F.col("PMID").alias("pmid"), F.col("Article.ArticleTitle").alias("title"), year.alias("year"), F.col("Article.Journal.Title").alias("venue"),
        F.array_join(F.col("Article.Abstract.AbstractText"), " ").alias("abstract"),
        F.transform(F.col("Article.AuthorList.Author"), lambda a: F.concat_ws(" ", a["ForeName"], a["LastName"])).alias("authors"),
        F.coalesce(F.array_contains(F.col("Article.PublicationTypeList.PublicationType"), "Review"), F.lit(False)).alias("is_review"),
    )


def parse_orcid(raw: DataFrame, column: str) -> DataFrame:
    """Name, current post (no end year, latest start) and works by year."""
    w = raw.select(F.from_json(column, ORCID).alias("w")).select("w.*").where("`orcid-identifier` is not null")
    current = F.array_sort(F.filter("employments", lambda e: e["end_year"].isNull()), lambda a, b: F.coalesce(b["start_year"], F.lit(0)) - F.coalesce(a["start_year"], F.lit(0)))
    kinds = F.create_map(*(F.lit(x) for kv in WORK_TYPES.items() for x in kv))
    works = F.transform("works", lambda x: F.struct(x["title"].alias("title"), F.coalesce(kinds[x["type"]], F.lit("other")).alias("kind"), x["year"].alias("year"), normalize_doi(x["doi"]).alias("doi")))
    return w.select(
        F.col("`orcid-identifier`.path").alias("orcid"), F.concat_ws(" ", F.col("person.name.`given-names`.value"), F.col("person.name.`family-name`.value")).alias("name"),
        F.get(current, 0)["organization"].alias("affiliation"), works.alias("works"),
    )


def parse_author(raw: DataFrame, column: str, concepts: int = 10) -> DataFrame:
    """Author records of a service: ids without their resolvers, names, institutions, counts and strongest concepts."""
    w = raw.select(F.from_json(column, AUTHOR).alias("w")).select("w.*").where("id is not null")
    return w.select(
        F.regexp_extract("id", r"([^/]+)$", 1).alias("openalex_id"), F.regexp_extract("orcid", r"([^/]+)$", 1).alias("orcid"), F.col("display_name").alias("name"),
        F.coalesce("display_name_alternatives", F.array().cast("array<string>")).alias("aliases"), F.transform("last_known_institutions", lambda i: i["display_name"]).alias("affiliations"),
        F.coalesce("works_count", F.lit(0)).alias("paper_count"), F.coalesce("cited_by_count", F.lit(0)).alias("citation_count"), F.col("summary_stats.h_index").alias("h_index"),
        F.slice(F.transform("x_concepts", lambda c: F.struct(c["display_name"].alias("name"), c["score"].alias("score"))), 1, concepts).alias("concepts"),
    )


def parse_orcid_more(raw: DataFrame, column: str) -> DataFrame:
    """Educations (latest first) and fundings (newest first) of an ORCID record."""
    w = raw.select(F.from_json(column, f"`orcid-identifier` struct<path:string>, {ORCID_MORE}").alias("w")).select("w.*").where("`orcid-identifier` is not null")
    late = lambda name: lambda a, b: F.coalesce(b[name], F.lit(0)) - F.coalesce(a[name], F.lit(0))
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    kinds = dict(p.split(" ", 1) for p in ORCID_MORE.split(", "))
    return w.select(F.col("`orcid-identifier`.path").alias("orcid"), F.array_sort(empty("educations", kinds["educations"]), late("end_year")).alias("educations"), F.array_sort(empty("fundings", kinds["fundings"]), late("year")).alias("fundings"))


def enrich(records: DataFrame, found: DataFrame) -> DataFrame:
    """Left join by DOI: missing values are filled, own concepts stand first. records and found have doi, title, year, venue, abstract, concepts."""
    best = found.where("doi is not null").dropDuplicates(["doi"])
    joined = records.alias("r").join(best.alias("f"), F.col("r.doi") == F.col("f.doi"), "left")
    same = [F.coalesce(f"r.{c}", f"f.{c}").alias(c) for c in ("doi", "title", "year", "venue", "abstract")]
    own, more = (F.coalesce(F.col(f"{x}.concepts"), F.array().cast("array<struct<name:string,score:double>>")) for x in ("r", "f"))
    return joined.select(*same, F.concat(own, more).alias("concepts"))
