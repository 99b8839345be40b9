"""URL filters against a list that changes over time, in DataFrame operations only.

Dated list entries become validity intervals per key; each capture is joined, by
the keys that may cover its URL, with the intervals that held when it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.llm.rows import BROADCAST_ROWS, small
from driftwood.sources.workspace import written


def host_of(url: Column) -> Column:
    """The lower-cased host, without user and port; '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys_of(url: Column) -> Column:
    """List keys that cover a URL: its host, every parent domain, and the host with each leading part of the path."""
    labels = F.split(host_of(url), r"\.")
    parts = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
    return F.when(host_of(url) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, F.filter(paths, lambda x: ~x.endswith("/")))))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, since, until) from (key, day, action): from an 'add' until the key's next entry, for ever if there is none.

    Of entries of one key and day the last of 'add' < 'remove' holds; rows with
    a null key, day or another action are ignored.
    """
    known = entries.where(F.col("action").isin("add", "remove") & F.col("key").isNotNull() & F.col("day").isNotNull()).groupBy("key", "day").agg(F.max("action").alias("action"))
    dated = known.withColumn("until", F.lead("day").over(Window.partitionBy("key").orderBy("day")))
    return dated.where("action = 'add'").select("key", F.col("day").alias("since"), "until")


def month_of(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def by_month(held: DataFrame, months: list[int]) -> DataFrame:
    """Intervals, once for every one of these months (those in which anything was captured) in which they hold.

    A capture then meets a key's intervals of its month only, 31 at most as there
    is one entry a day, however long the key's history is; and a key that covers
    very many captures is spread over the months.
    """
    a, b = month_of(F.col("since")), F.coalesce(month_of(F.date_sub("until", 1)), F.lit(2**31 - 1))
    own = F.filter(F.array(*map(F.lit, months)).cast("array<int>"), lambda x: (a <= x) & (x <= b))
    return held.select("key", "since", "until", F.explode(own).alias("month"))


def url_filtered(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Every capture with the list entries active when it was fetched.

    captures: page_id bigint, url, fetched date; entries: key (a domain, which
    covers its subdomains, or host/path, which covers all below), day date,
    action. Returns page_id, url, fetched, n_active, entry (the longest active
    key, of equals the first; null if none) and blocked. A capture with a null
    or unreadable url or no fetch date matches nothing. Repeated rows are each
    returned; other columns are ignored. An empty list blocks nothing, and no
    captures give no rows. Urls may be of any length.
    """
    captures = captures.select("page_id", "url", "fetched")
    cover = captures.distinct().where("fetched is not null").select("url", "fetched", F.explode(keys_of(F.col("url"))).alias("key"), month_of(F.col("fetched")).alias("month"))
    # months that occur: a calendar of 9999 years has 119,988
    months = sorted(r.month for r in captures.select(month_of(F.col("fetched")).alias("month")).where("month is not null").distinct().collect())
    held = written(by_month(intervals(entries), months), "list-intervals")
    keys = written(held.select("key").distinct(), "list-keys")
    if keys.count() <= BROADCAST_ROWS:  # most keys of a capture are on no list
        cover = cover.join(F.broadcast(keys), "key", "left_semi")
    active = (F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    hits = cover.distinct().join(small(held, held.count()), ["key", "month"]).where(active).groupBy("url", "fetched").agg(
        F.count("*").alias("n_active"), F.min(F.struct((-F.length("key")).alias("size"), "key"))["key"].alias("entry"),
    )
    hits = hits.withColumnsRenamed({"url": "hit_url", "fetched": "hit_day"})
    return captures.join(hits, (F.col("url") == F.col("hit_url")) & (F.col("fetched") == F.col("hit_day")), "left").select(
        "page_id", "url", "fetched", F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"), "entry", F.col("n_active").isNotNull().alias("blocked"),
    )
