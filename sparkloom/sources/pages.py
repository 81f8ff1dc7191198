"""REST list pages, diffs and states, from landed files or live through an injected client."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def next_page_url(link: Column) -> Column:
    """The url of the part of a Link header that says rel="next"; null without one."""
    parts = F.filter(F.split(link, ","), lambda p: F.contains(p, F.lit('rel="next"')))
    return F.regexp_replace(F.trim(F.element_at(F.split(F.get(parts, F.lit(0)), ";"), 1)), "^<+|>+$", "")


def with_query_value(url: Column, name: str, value: str, scheme: str) -> Column:
    """Urls of ``scheme`` with ``name`` set to ``value`` in their query; other parameters stay as they are, blank ones go.

    A parameter that is there already keeps its place. Urls of other schemes, and nulls, are unchanged.
    """
    rest, fragment = F.regexp_extract(url, r"^([^#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)
    base, query = F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"\?(.*)$", 1)
    ours = f"{name}={value}"
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]+=.")), lambda p: F.when(p.startswith(f"{name}="), ours).otherwise(p))
    merged = F.array_join(F.when(F.array_contains(pairs, ours), F.array_distinct(pairs)).otherwise(F.array_append(pairs, F.lit(ours))), "&")
    return F.when(url.startswith(f"{scheme}:"), F.concat(base, F.lit("?"), merged, fragment)).otherwise(url)


def paginate(get: Callable[[str, dict], tuple[list, str | None]], url: str, params: dict | None = None, max_items: int | None = None) -> Iterator[dict]:
    """Items of a list of pages; ``get`` gives a page and the next url.

    It ends on an empty or short page, without a next url or with the same one again, and after ``max_items``. A page
    that is no list is an error.
    """
    seen, now, size = 0, url, (params or {}).get("per_page", 30)
    while now:
        page, following = get(now, params or {} if now == url else {})
        if page and not isinstance(page, list):
            raise RuntimeError(f"a list was expected, not {type(page).__name__}")
        for item in page or []:
            yield item
            seen += 1
            if max_items and seen >= max_items:
                return
        if not page or len(page) < size or following == now:
            return
        now = following


class ListSource(DataSource):
    """spark.read.format("rest_list"): an option ``urls`` (blank-separated) is read a partition each, by ``client``."""

    client: Callable[[str, dict], tuple[list, str | None]] | None = None

    @classmethod
    def name(cls) -> str:
        return "rest_list"

    def schema(self) -> str:
        return "url string, item string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, type(self).client)


class _Reader(DataSourceReader):
    def __init__(self, options, client):
        self.urls, self.limit, self.size, self.client = options["urls"].split(), int(options.get("max_items", 0)) or None, int(options.get("per_page", 100)), client

    def partitions(self):
        return [InputPartition(u) for u in self.urls]

    def read(self, partition):
        import json

        for item in paginate(self.client, partition.value, {"per_page": self.size}, self.limit):
            yield partition.value, json.dumps(item)


def landed_comments(spark: SparkSession, path: str, schema: str, max_items: int | None = None) -> DataFrame:
    """Comments landed as JSON, newest first; ``max_items`` keeps the newest."""
    rows = spark.read.schema(schema).json(path).orderBy(F.desc("created_at"), F.desc("id"))
    return rows.limit(max_items) if max_items else rows


def comments_of_pull(comments: DataFrame, owner: str, repo: str, number: int) -> DataFrame:
    """The comments of one pull request, by the end of their ``pull_request_url``: a filter of the scan."""
    return comments.where(F.col("pull_request_url").endswith(f"/repos/{owner}/{repo}/pulls/{number}"))


def comments_of_pull_url(owner: str, repo: str, number: int) -> str:
    """Where a live client lists them, for the ``urls`` of "rest_list"."""
    return f"/repos/{owner}/{repo}/pulls/{number}/comments"


def diffs(spark: SparkSession, path: str) -> DataFrame:
    """A row (file, diff) for each landed diff, whole or between two heads."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("diff"))


def repositories(listing: DataFrame) -> DataFrame:
    return listing.select("id", "name", F.col("owner.login").alias("owner"))


def pull_states(pulls: DataFrame) -> DataFrame:
    return pulls.select(F.col("number").alias("pr_number"), F.col("head.sha").alias("head_sha"), "state")
