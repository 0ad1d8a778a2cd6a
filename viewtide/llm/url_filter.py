"""URL filters: dated list entries as validity intervals, joined as of each capture's fetch time.

A list entry adds or removes a key of a list at a time. Two kinds of key exist: a domain, which
covers itself and its subdomains, and a prefix, a host with the first segments of a path. Entries
of one (list, kind, key) become intervals from one entry to the next; an entry that adds opens the
interval. A capture is expanded to the keys it falls under: the suffixes of its host, and its path
prefixes up to the longest that any entry has. The join is on equal keys with the fetch time
inside the interval, so each capture meets just the entries active when it was fetched. Only
DataFrame expressions are used; a key shared by very many captures is split by the adaptive planner, as
the interval side of a key is small.

Defined cases: a null or unparsable url has no host and matches nothing. A null fetch time matches
nothing. Entries with a null in list, kind, key, time or action are ignored. Repeated entries count once; at equal
times a removal wins over an addition. Letters of hosts and keys' hosts are compared in lower case.
Rows that repeat an id share their matches. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOMAIN, PREFIX = "domain", "prefix"


def host(url: Column | str) -> Column:
    """Lower-case host of a url without user, port and a final dot; empty if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", ""))


def segments(url: Column | str) -> Column:
    """Non-empty path segments of a url."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda x: x != "")


def intervals(entries: DataFrame) -> DataFrame:
    """list, kind, key, since, until (null: open) during which a key is on a list, from entries (list, kind, key, at, action)."""
    valid = entries.select("list", "kind", "key", "at", "action").dropna().where(F.col("action").isin("add", "remove"))
    last = valid.groupBy("list", "kind", "key", "at").agg(F.max("action").alias("action"))  # remove sorts after add
    order = Window.partitionBy("list", "kind", "key").orderBy("at")
    return last.withColumn("until", F.lead("at").over(order)).where("action = 'add'").select("list", "kind", "key", F.col("at").alias("since"), "until")


def capture_keys(captures: DataFrame, depth: int) -> DataFrame:
    """id, fetched_at, kind, key of everything a capture falls under, prefixes up to ``depth`` segments."""
    parts = F.split("host", r"\.")
    count = F.size(parts)
    domains = F.transform(F.sequence(F.lit(1), count), lambda i: F.struct(F.lit(DOMAIN).alias("kind"), F.array_join(F.slice(parts, i, count - i + 1), ".").alias("key")))
    deep = F.least(F.size("path"), F.lit(depth))
    prefixes = F.transform(
        F.when(deep > 0, F.sequence(F.lit(1), deep)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.lit(PREFIX).alias("kind"), F.concat("host", F.lit("/"), F.array_join(F.slice("path", F.lit(1), i), "/")).alias("key")),
    )
    rows = captures.select("id", "fetched_at", host("url").alias("host"), segments("url").alias("path")).where("host <> ''")
    return rows.select("id", "fetched_at", F.explode(F.concat(domains, prefixes)).alias("k")).select("id", "fetched_at", "k.kind", "k.key")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """id, fetched_at, blocked, n_matches, lists (sorted, comma-separated) for captures (id, url, fetched_at)."""
    active = intervals(entries)
    depth = active.where(F.col("kind") == PREFIX).agg(F.max(F.size(F.split("key", "/"))) - 1).first()[0] or 0
    keys = capture_keys(captures, int(depth))
    hits = keys.join(active, ["kind", "key"]).where((F.col("since") <= F.col("fetched_at")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until"))))
    per = hits.select("id", "list", "kind", "key").distinct().groupBy("id").agg(F.count("*").alias("n_matches"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    out = captures.select("id", "fetched_at").join(per, "id", "left")
    return out.select("id", "fetched_at", F.col("n_matches").isNotNull().alias("blocked"), F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.coalesce("lists", F.lit("")).alias("lists"))


def keep_allowed(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows of ``captures`` that no active entry covers; a null id cannot be matched and stays."""
    gone = evaluate(captures, entries).where("blocked").select("id").distinct()
    return captures.join(gone, "id", "left_anti").select(*captures.columns)


def _number(text: Column, first: int, digits: int = 4) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), first, digits), 16, 10).cast("int")


def dated_pages(pages: DataFrame, start: str = "2024-01-01") -> DataFrame:
    """Captures of ``pages``, which carry no dates: the fetch day follows from the page's id and url."""
    day = _number(F.concat_ws("|", F.col("page_id").cast("string"), "url"), 1) % 360
    return pages.select(F.col("page_id").alias("id"), "url", F.date_add(F.lit(start).cast("date"), day).alias("fetched_at"))


def dated_entries(pages: DataFrame, start: str = "2024-01-01") -> DataFrame:
    """List entries over the hosts and first path segments seen in ``pages``: added, mostly removed, partly added again."""
    rows = pages.select(host("url").alias("host"), segments("url").alias("path")).where("host <> ''")
    parts = F.split("host", r"\.")
    domain = F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 2), F.lit(3)), ".")
    keys = rows.select(F.lit(DOMAIN).alias("kind"), domain.alias("key")).unionAll(rows.select(F.lit(DOMAIN), "host"))
    keys = keys.unionAll(rows.where(F.size("path") > 0).select(F.lit(PREFIX), F.concat("host", F.lit("/"), F.col("path")[0]))).distinct()
    chosen = keys.where(_number(F.col("key"), 5) % 3 != 0)
    name = F.when(F.col("key").contains("spam"), "spam").when(F.col("key").contains("adult"), "adult").otherwise(F.concat(F.lit("list"), (_number(F.col("key"), 9) % 4).cast("string")))
    first, second, third = _number(F.col("key"), 13) % 300, 1 + _number(F.col("key"), 17) % 90, 1 + _number(F.col("key"), 21) % 60
    day = lambda n: F.date_add(F.lit(start).cast("date"), n)
    event = lambda n, action: F.struct(day(n).alias("at"), F.lit(action).alias("action"))
    events = F.array(event(first, "add"), event(first + second, "remove"), event(first + second + third, "add"))
    return chosen.select(name.alias("list"), "kind", "key", F.explode(F.slice(events, F.lit(1), 1 + _number(F.col("key"), 25) % 3)).alias("e")).select("list", "kind", "key", "e.at", "e.action")


SQL = r"""
WITH parsed AS (
  SELECT page_id, url, lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '\.?(:[0-9]*)?$', '')) AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS path,
    DATE '2024-01-01' + CAST(CAST('0x' || substr(md5(concat_ws('|', CAST(page_id AS VARCHAR), url)), 1, 4) AS INTEGER) % 360 AS INTEGER) AS fetched_at
  FROM pages
), hosted AS (SELECT *, string_split(host, '.') AS parts FROM parsed WHERE host <> ''),
all_keys AS (
  SELECT 'domain' AS kind, array_to_string(list_slice(parts, greatest(1, len(parts) - 2), greatest(1, len(parts) - 2) + 2), '.') AS key FROM hosted
  UNION SELECT 'domain', host FROM hosted
  UNION SELECT 'prefix', host || '/' || path[1] FROM hosted WHERE len(path) > 0
), numbered AS (
  SELECT kind, key, list_transform([5, 9, 13, 17, 21, 25], lambda i: CAST('0x' || substr(md5(key), CAST(i AS INTEGER), 4) AS INTEGER)) AS n FROM all_keys
), chosen AS (
  SELECT kind, key, n, CASE WHEN contains(key, 'spam') THEN 'spam' WHEN contains(key, 'adult') THEN 'adult' ELSE 'list' || CAST(n[2] % 4 AS VARCHAR) END AS list,
    n[3] % 300 AS a, n[3] % 300 + 1 + n[4] % 90 AS b, n[3] % 300 + 2 + n[4] % 90 + n[5] % 60 AS c FROM numbered WHERE n[1] % 3 <> 0
), active AS (
  SELECT list, kind, key, DATE '2024-01-01' + CAST(a AS INTEGER) AS since, CASE WHEN n[6] % 3 >= 1 THEN DATE '2024-01-01' + CAST(b AS INTEGER) END AS until FROM chosen
  UNION ALL SELECT list, kind, key, DATE '2024-01-01' + CAST(c AS INTEGER), NULL FROM chosen WHERE n[6] % 3 = 2
), capture_keys AS (
  SELECT page_id, fetched_at, 'domain' AS kind, array_to_string(list_slice(parts, i, len(parts)), '.') AS key FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM hosted)
  UNION ALL SELECT page_id, fetched_at, 'prefix', host || '/' || path[1] FROM hosted WHERE len(path) > 0
), hits AS (
  SELECT DISTINCT page_id, list, k.kind, k.key FROM capture_keys k JOIN active a ON k.kind = a.kind AND k.key = a.key AND a.since <= k.fetched_at AND (a.until IS NULL OR k.fetched_at < a.until)
), per AS (SELECT page_id, count(*) AS n_matches, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM hits GROUP BY page_id)
SELECT p.page_id, p.fetched_at, per.n_matches IS NOT NULL AS blocked, coalesce(per.n_matches, 0) AS n_matches, coalesce(per.lists, '') AS lists
FROM parsed p LEFT JOIN per USING (page_id)
"""
