"""A Python data source over a bibliographic service, and the parsing of its records.

The service is a pluggable client, so that the plan (key lookups, year and citation filters pushed to the service, pages
as partitions) can be tested without a network.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual

from athenor.functions.exprs import looks_like_review, normalize_doi

SCHEMA = "id string, title string, year int, citation_count bigint, raw string"


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class WorksReader(DataSourceReader):
    """Pages of works; filters that the service knows go along with each request, others stay with Spark."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.pushed = options, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") else None
            if isinstance(f, GreaterThanOrEqual) and name == "year":
                self.pushed["year_min"] = f.value
            elif isinstance(f, LessThanOrEqual) and name == "year":
                self.pushed["year_max"] = f.value
            elif isinstance(f, EqualTo) and name == "id":
                self.pushed["id"] = f.value
            else:
                yield f

    def partitions(self) -> list[Page]:
        return [Page(n) for n in range(int(self.options.get("pages", "1")))]

    def read(self, page: Page) -> Iterator[tuple]:
        import importlib

        module, _, name = self.options["client"].partition(":")
        client: Any = getattr(importlib.import_module(module), name)
        for row in client(page.number, int(self.options.get("page_size", "50")), dict(self.pushed)):
            yield tuple(row)


class WorksSource(DataSource):
    """Needs ``spark.sql.python.filterPushdown.enabled``.

    ``spark.read.format("works").option("client", "module:function").option("pages", n)``.
    """

    @classmethod
    def name(cls) -> str:
        return "works"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> WorksReader:
        return WorksReader(dict(self.options))


WORK = (
    "id string, doi string, title string, publication_year int, type string, cited_by_count bigint, referenced_works array<string>, "
    "authorships array<struct<author:struct<id:string,display_name:string>>>, concepts array<struct<display_name:string,score:double>>"
)


def parse_works(raw: DataFrame, column: str) -> DataFrame:
    """Service records in JSON as papers: ten authors, ten concepts, DOI without prefix, review by type or title."""
    w = raw.select(F.from_json(column, WORK).alias("w")).select("w.*").where("id is not null")
    return w.select(
        F.col("id").alias("openalex_id"),
        normalize_doi("doi").alias("doi"),
        "title",
        F.col("publication_year").alias("year"),
        F.coalesce("cited_by_count", F.lit(0)).alias("citation_count"),
        F.size(F.coalesce("referenced_works", F.array())).cast("bigint").alias("reference_count"),
        F.slice(F.transform("authorships", lambda a: a["author"]["display_name"]), 1, 10).alias("authors"),
        F.slice(F.transform("authorships", lambda a: a["author"]["id"]), 1, 10).alias("author_ids"),
        F.slice(F.transform("concepts", lambda c: F.struct(c["display_name"].alias("name"), c["score"].alias("score"))), 1, 10).alias("concepts"),
        looks_like_review("title", "type").alias("is_review"),
    )
