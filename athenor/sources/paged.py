"""A paged bibliographic service as a batch and a streaming source.

``spark.read.format("paged")`` with the options ``client`` ("module:function"), ``search``, ``sort``, ``limit``, ``per_page`` and, for walks by cursor,
``years`` ("1990-2002"). The client gets one request, a dict with search, sort, per_page, year_min, year_max, id and either ``page`` (from 1) or ``cursor``
("*" first), and gives ``{"results": rows, "count": n, "next": cursor or None}``.

Search and sort are the service's; a limit is so many pages of a sorted list, each an input partition. Cursors can only be followed one after
the other, so a walk by cursor has one partition for each year, which follows its own chain. All that a request needs is in its partition: a task that runs
again sends the same requests. Filters on year and id go along; all others stay with Spark. As a stream, the offset is the number of pages
that are full or were there when it was asked for.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual

from athenor.sources.api import SCHEMA


def _client(options: dict[str, str]) -> Callable[[dict], dict]:
    module, _, name = options["client"].partition(":")
    return getattr(importlib.import_module(module), name)


def _request(options: dict[str, str], **more: Any) -> dict:
    own = {k: options[k] for k in ("search", "sort") if options.get(k)}
    return {**own, "per_page": int(options.get("per_page", "50")), **more}


@dataclass
class Pages(InputPartition):
    """One page, or the whole chain of cursors that begins with the request's."""

    request: dict = field(default_factory=dict)
    most: int | None = None  # rows wanted of it


def _rows(client: Callable[[dict], dict], part: Pages) -> Iterator[tuple]:
    request, left = dict(part.request), part.most
    while True:
        got = client(request)
        for row in got["results"][:left]:
            yield tuple(row)
        if "cursor" not in request or not got.get("next"):
            return
        request = {**request, "cursor": got["next"]}


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.pushed = options, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        known = {(GreaterThanOrEqual, "year"): "year_min", (LessThanOrEqual, "year"): "year_max", (EqualTo, "id"): "id"}
        for f in filters:
            name = known.get((type(f), f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None))
            if name is None or name in self.pushed:
                yield f
            else:
                self.pushed[name] = f.value

    def partitions(self) -> list[Pages]:
        if "years" in self.options:
            first, last = (int(y) for y in self.options["years"].split("-"))
            first, last = max(first, self.pushed.get("year_min", first)), min(last, self.pushed.get("year_max", last))
            return [Pages(_request(self.options, **self.pushed | {"year_min": y, "year_max": y}, cursor="*")) for y in range(first, last + 1)] or [Pages({}, 0)]
        size = int(self.options.get("per_page", "50"))
        count = _client(self.options)(_request(self.options, **self.pushed, page=1) | {"per_page": 1})["count"]
        wanted = min(count, int(self.options.get("limit", count)))
        return [Pages(_request(self.options, **self.pushed, page=n + 1), min(size, wanted - n * size)) for n in range(-(-wanted // size))] or [Pages({}, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return iter(()) if not partition.request else _rows(_client(self.options), partition)


class PagedStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.size = options, int(options.get("per_page", "50"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"rows": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"rows": _client(self.options)(_request(self.options, page=1) | {"per_page": 1})["count"]}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        """The pages that hold rows start to end; the first and the last are cut to them."""
        a, b, size = start["rows"], end["rows"], self.size
        return [Pages(_request(self.options, page=n + 1) | {"from": max(a - n * size, 0)}, min(b - n * size, size)) for n in range(a // size, -(-b // size))] if b > a else []

    def read(self, partition: Pages) -> Iterator[tuple]:
        request = dict(partition.request)
        skip = request.pop("from")
        yield from list(_rows(_client(self.options), Pages(request, partition.most)))[skip:]


class PagedSource(DataSource):
    """Needs ``spark.sql.python.filterPushdown.enabled`` for pushed filters. A service that lists its newest works last can be streamed."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> PagedReader:
        return PagedReader(dict(self.options))

    def streamReader(self, schema: Any) -> PagedStream:  # noqa: N802
        return PagedStream(dict(self.options))
