"""Comments and diffs of a REST service as data sources: filters become requests, and a list is read on as a stream.

A service is a class with two functions, given as ``client`` of a subclass and called in the tasks (``page``) or once a trigger in
the driver (``count``):

    page(url, params)  -> (items, next url or None)
    count(url, params) -> how many items the list has (services tell by the last page of pages of one item)

Filters reach the reader only with spark.sql.python.filterPushdown.enabled.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from sparkloom.sources.pages import comments_of_pull_url, paginate

PUBLIC_LIMIT = 2000


class _Keys:
    """Which values the filters of a scan leave for the columns that make up a request."""

    def __init__(self, columns: tuple[str, ...]):
        self.columns, self.values = columns, {}

    def take(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equalities and lists of values of these columns; yields the filters that are left for Spark."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name not in self.columns:
                yield f
                continue
            found = [f.value] if isinstance(f, EqualTo) else [v for v in f.value if v is not None]
            had = self.values.get(name)
            self.values[name] = [v for v in dict.fromkeys(found) if had is None or v in had]

    def combined(self, columns: tuple[str, ...], option: dict) -> list[tuple]:
        """Each combination of the values of ``columns``; an option of that name stands in where no filter does."""
        rows = [()]
        for c in columns:
            values = self.values[c] if c in self.values else [option[c]] if option.get(c) else None
            if values is None:
                raise ValueError(f"a filter or an option for {c} is needed, or the whole service would be read")
            rows = [(*r, v) for r in rows for v in values]
        return rows


class ReviewComments(DataSource):
    """spark.read.format("review_comments"): owner, repo, pr_number, item (JSON).

    Filters on owner, repo and pr_number become the url, a partition each: a pull's comments, or all of a repository. With the option
    ``public`` a repository's newest ``max_items`` (2,000 if not given) are read, and none without a ``token``.
    """

    client = None

    @classmethod
    def name(cls) -> str:
        return "review_comments"

    def schema(self) -> str:
        return "owner string, repo string, pr_number long, item string"

    def reader(self, schema) -> DataSourceReader:
        return _CommentsReader(dict(self.options), type(self).client)


def pull_number(item: dict) -> int | None:
    last = (item.get("pull_request_url") or "").rpartition("/")[2]
    return int(last) if last.isdigit() else None


class _CommentsReader(DataSourceReader):
    def __init__(self, options: dict, client):
        self.options, self.client, self.keys = options, client, _Keys(("owner", "repo", "pr_number"))
        self.public = options.get("public", "").lower() == "true"
        self.limit = int(options.get("max_items") or (PUBLIC_LIMIT if self.public else 0)) or None

    def pushFilters(self, filters):
        yield from self.keys.take(filters)

    def partitions(self):
        if self.public and not self.options.get("token"):
            warnings.warn("no token: the public source is empty", stacklevel=1)
            return [InputPartition(None)]
        columns = ("owner", "repo", "pr_number") if "pr_number" in self.keys.values else ("owner", "repo")
        return [InputPartition(k) for k in self.keys.combined(columns, self.options)] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        owner, repo, *pull = partition.value
        params = {"per_page": int(self.options.get("per_page", 100))}
        if pull:
            url = comments_of_pull_url(owner, repo, pull[0])
        else:
            url, params = f"/repos/{owner}/{repo}/pulls/comments", params | {"sort": "created", "direction": "desc"}
        for item in paginate(self.client.page, url, params, self.limit):
            yield owner, repo, pull[0] if pull else pull_number(item), json.dumps(item)


class Diffs(DataSource):
    """spark.read.format("diffs"): owner, repo, pr_number, before_sha, after_sha, diff.

    Each combination that filters leave is one request: of two heads if before_sha and after_sha are given, else of a whole pull.
    """

    client = None

    @classmethod
    def name(cls) -> str:
        return "diffs"

    def schema(self) -> str:
        return "owner string, repo string, pr_number long, before_sha string, after_sha string, diff string"

    def reader(self, schema) -> DataSourceReader:
        return _DiffReader(dict(self.options), type(self).client)


class _DiffReader(DataSourceReader):
    def __init__(self, options: dict, client):
        self.options, self.client, self.keys = options, client, _Keys(("owner", "repo", "pr_number", "before_sha", "after_sha"))

    def pushFilters(self, filters):
        yield from self.keys.take(filters)

    def partitions(self):
        compared = {"before_sha", "after_sha"} & set(self.keys.values)
        columns = ("owner", "repo", "before_sha", "after_sha") if compared else ("owner", "repo", "pr_number")
        pull = self.keys.values.get("pr_number", [None]) if compared else [None]
        rows = [(*k, p) for k in self.keys.combined(columns, self.options) for p in pull]
        return [InputPartition((bool(compared), r)) for r in rows] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        compared, row = partition.value
        if compared:
            owner, repo, before, after, pull = row
            text, _ = self.client.page(f"/repos/{owner}/{repo}/compare/{before}...{after}", {"accept": "diff"})
        else:
            owner, repo, pull, _ = row
            before, after = None, None
            text, _ = self.client.page(f"/repos/{owner}/{repo}/pulls/{pull}", {"accept": "diff"})
        yield owner, repo, pull, before, after, text


class ListStream(DataSource):
    """spark.readStream.format("rest_list_stream"): position, item (JSON) of a list in the order its items were made.

    The offset is the number of items read. A trigger asks how many there are and reads the pages between, a partition each, in the tasks;
    a page that was full when read is never asked for again, whether the query ran on or was restarted from its checkpoint. Options:
    url, per_page (100), max_items (in all; 2,000 if ``public``), public and token: a public list without a token is empty.
    """

    client = None

    @classmethod
    def name(cls) -> str:
        return "rest_list_stream"

    def schema(self) -> str:
        return "position long, item string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _ListStreamReader(dict(self.options), type(self).client)


class _ListStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict, client):
        self.url, self.size, self.client = options["url"], int(options.get("per_page", 100)), client
        public = options.get("public", "").lower() == "true"
        self.closed = public and not options.get("token")
        self.limit = int(options.get("max_items") or (PUBLIC_LIMIT if public else 0)) or None
        self.params = {"sort": "created", "direction": "asc"}
        self.committed = 0
        if self.closed:
            warnings.warn("no token: the public source is empty", stacklevel=1)

    def initialOffset(self) -> dict:
        return {"items": 0}

    def latestOffset(self) -> dict:
        if self.closed:
            return {"items": 0}
        there = self.client.count(self.url, self.params)
        return {"items": max(self.committed, there if self.limit is None else min(there, self.limit))}

    def partitions(self, start: dict, end: dict):
        first, last = int(start["items"]), int(end["items"])
        return [InputPartition((page, max(first, page * self.size), min(last, (page + 1) * self.size))) for page in range(first // self.size, -(-last // self.size))] if last > first else []

    def read(self, partition):
        page, first, last = partition.value
        items, _ = self.client.page(self.url, self.params | {"per_page": self.size, "page": page + 1})
        if not isinstance(items, list):
            raise RuntimeError(f"a list was expected, not {type(items).__name__}")
        here = items[first - page * self.size : last - page * self.size]
        if len(here) < last - first:
            raise RuntimeError(f"page {page + 1} of {self.url} has lost items since they were counted")
        for k, item in enumerate(here):
            yield first + k, json.dumps(item)

    def commit(self, end: dict) -> None:
        self.committed = max(self.committed, int(end["items"]))
