"""URL filters by a temporal list join.

List entries are dated: an ``add`` puts a rule into force, a ``remove`` or another ``add`` ends it. The events of an entry
become validity intervals, and each capture is judged by the entries active when it was fetched: for every rule key a URL
can match, the as-of join takes the interval that holds the fetch time.

A rule is a key and a verdict. Keys of a URL, from the most specific: the URL itself (no scheme, query or fragment), its
folders of every level, the host and its parent domains. The most specific active rule decides; of equally
specific ones ``block`` wins.

A host may have a third of all captures. Intervals are therefore joined with the distinct (key, day) pairs of the
captures, which are combined on the map side before they are dealt; the answers go back to the captures by (key, day), so that
a hot host is spread over its days, and the adaptive join splits what is left. All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.columns import load, needs, own_name
from larder.llm.registered import query
from larder.session import written

FOREVER = "9999-12-31"


def validity(events: DataFrame) -> DataFrame:
    """(key, verdict, valid_from, valid_to): intervals, valid_to excluded, of dated list entries.

    ``events``: list_id, key, action (add or remove), verdict (block or allow), day (date). Events of one list and key take
    effect in the order of their days; of several on one day the last of (remove, add allow, add block) holds. An entry that
    is never removed is open-ended. Rows with a null list, key, action or day, unknown actions and empty spans are ignored.
    """
    needs(events, "list_id", "key", "action", "verdict", "day")
    rank = F.when(F.col("action") == "remove", 0).when(F.col("verdict") == "block", 2).otherwise(1)
    daily = (
        events.where(F.col("action").isin("add", "remove") & F.col("list_id").isNotNull() & F.col("key").isNotNull() & F.col("day").isNotNull())
        .groupBy("list_id", "key", F.col("day").cast("date").alias("valid_from"))
        .agg(F.max(rank).alias("state"))
    )
    order = Window.partitionBy("list_id", "key").orderBy("valid_from")
    return (
        daily.withColumn("valid_to", F.coalesce(F.lead("valid_from").over(order), F.lit(FOREVER).cast("date")))
        .where("state > 0")
        .select("key", F.when(F.col("state") == 2, "block").otherwise("allow").alias("verdict"), "valid_from", "valid_to")
    )


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and a trailing dot; empty if the URL has none."""
    authority = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def rule_keys(url: Column, folders: int | None = None) -> Column:
    """All keys a URL can match, the most specific first: url, folders, host, parent domains with two labels or more.

    Folders of all levels, or of the first ``folders`` ones.
    """
    host, path = host_of(url), path_of(url)
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    levels = F.size(steps) - 1 if folders is None else F.least(F.size(steps) - 1, F.lit(folders))
    deep = F.transform(
        F.sequence(F.greatest(levels, F.lit(1)), F.lit(1), F.lit(-1)),
        lambda n: F.when(n <= levels, F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, n), "/"), F.lit("/"))),
    )
    labels = F.split(host, r"\.")
    last = F.greatest(F.size(labels) - 1, F.lit(1))
    domains = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = F.concat(F.array(F.concat(host, path)), deep, domains)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))
    )


def judge_captures(
    captures: DataFrame, events: DataFrame, url_col: str = "url", day_col: str = "day", folders: int | None = None
) -> DataFrame:
    """``captures`` with rule (the key that decided, or null) and allowed (false if a block rule decided).

    Captures whose URL is null, empty or without a host, and captures without a fetch day, match no rule and are allowed. Repeated
    captures are judged each; other columns pass through, those named rule or allowed are replaced. Empty lists allow
    everything. Folders count down to the deepest level that is listed, or to ``folders`` if given. Runs jobs: the intervals
    and the verdicts are written.
    """
    needs(captures, url_col, day_col)
    keep = [c for c in captures.columns if c.lower() not in ("rule", "allowed")]
    site, when, at, on, rule, ok = (own_name(captures, label) for label in ("site", "when", "at", "on", "rule", "ok"))
    # All keys of a URL follow from host and path: one row per (host and path, day) is judged.
    place = F.concat(host_of(F.col(url_col)), path_of(F.col(url_col)))
    full = captures.select(
        *[f"`{c}`" for c in keep],
        F.when(host_of(F.col(url_col)) != "", place).alias(site),
        F.col(day_col).cast("date").alias(when),
    )
    intervals = written(validity(events), "intervals")
    if folders is None:
        parts = F.filter(F.split("key", "/"), lambda s: s != "")
        folders = intervals.where(F.col("key").endswith("/")).agg(F.max(F.size(parts) - 1)).first()[0] or 0
    asked = full.where(F.col(site).isNotNull() & F.col(when).isNotNull()).select(F.col(site).alias("site"), F.col(when).alias("seen")).distinct()
    asked = asked.select("site", "seen", F.posexplode(rule_keys(F.concat(F.lit("x://"), F.col("site")), folders)).alias("depth", "key"))
    # Many sites share a host key on a day: the intervals meet each (key, day) once.
    pairs = asked.select("key", "seen").distinct()
    active = (
        pairs.join(intervals, "key")
        .where("valid_from <= seen AND seen < valid_to")
        .groupBy("key", "seen")
        .agg(F.max("verdict").alias("verdict"))
    )
    verdicts = written(
        asked.join(active, ["key", "seen"])
        .groupBy("site", "seen")
        .agg(F.min(F.struct("depth", "key", "verdict")).alias("first"))
        .select(
            F.col("site").alias(at), F.col("seen").alias(on), F.col("first.key").alias(rule), (F.col("first.verdict") != "block").alias(ok)
        ),
        "verdicts",
    )
    return full.join(verdicts, (F.col(site) == F.col(at)) & (F.col(when) == F.col(on)), "left").select(
        *[f"`{c}`" for c in keep], F.col(rule).alias("rule"), F.coalesce(ok, F.lit(True)).alias("allowed")
    )


def lists_from_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(captures, events) derived from ``pages`` (page_id, url): the table has neither fetch days nor lists.

    A page was fetched on a day of 2024 fixed by its number. Every host and its parent domain is listed or not by a digest
    of its name: some are blocked in one span or two, some allowed; a folder of some hosts is listed as well.
    """
    day = lambda name, salt: F.date_add(
        F.lit("2024-01-01").cast("date"), (F.conv(F.substring(F.md5(F.concat(F.lit(salt), name)), 1, 6), 16, 10).cast("long") % 366).cast("int")
    )
    captures = pages.select("page_id", "url", day(F.col("page_id").cast("string"), "fetch").alias("day"))
    hosts = pages.select(host_of(F.col("url")).alias("host"), F.regexp_extract(path_of(F.col("url")), r"^/([^/]+)/", 1).alias("folder")).distinct()
    named = (
        hosts.select(F.col("host").alias("key"))
        .union(hosts.select(F.regexp_replace("host", r"^[^.]*\.", "")))
        .union(hosts.where("folder <> ''").select(F.concat("host", F.lit("/"), "folder", F.lit("/"))))
        .where("key LIKE '%.%'")
        .distinct()
        .withColumn("kind", F.substring(F.md5("key"), 1, 1))
    )
    key = F.col("key")
    event = lambda salt, action, verdict: F.struct(
        F.lit(f"list{salt}").alias("list_id"), F.lit(action).alias("action"), F.lit(verdict).alias("verdict"), day(key, f"{action}{salt}").alias("day")
    )
    events = F.when(F.col("kind").isin(*"01234567"), F.array(event(1, "add", "block"), event(1, "remove", "block"))).when(
        F.col("kind").isin(*"89a"), F.array(event(1, "add", "block"), event(2, "add", "allow"), event(2, "remove", "allow"))
    ).when(F.col("kind").isin("b", "c"), F.array(event(2, "add", "allow")))
    return captures, named.select("key", F.explode(events).alias("e")).select("e.list_id", "key", "e.action", "e.verdict", "e.day")


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, url, lower(url) AS low,
         regexp_replace(regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.+$', '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path,
         CAST('2024-01-01' AS DATE) + CAST(CAST('0x' || substr(md5('fetch' || page_id), 1, 6) AS BIGINT) % 366 AS INTEGER) AS day
  FROM pages),
h AS (SELECT DISTINCT host, regexp_extract(path, '^/([^/]+)/', 1) AS folder FROM p),
names AS (SELECT DISTINCT key FROM (SELECT host AS key FROM h UNION ALL SELECT regexp_replace(host, '^[^.]*\.', '') FROM h
          UNION ALL SELECT host || '/' || folder || '/' FROM h WHERE folder <> '') WHERE key LIKE '%.%'),
kinds AS (SELECT key, substr(md5(key), 1, 1) AS kind FROM names),
ev AS (SELECT key, e.list AS list_id, e.action AS action, e.verdict AS verdict,
              CAST('2024-01-01' AS DATE) + CAST(CAST('0x' || substr(md5(e.action || e.salt || key), 1, 6) AS BIGINT) % 366 AS INTEGER) AS day
       FROM (SELECT key, unnest(CASE
         WHEN kind IN ('0','1','2','3','4','5','6','7') THEN [{'list': 'list1', 'salt': '1', 'action': 'add', 'verdict': 'block'}, {'list': 'list1', 'salt': '1', 'action': 'remove', 'verdict': 'block'}]
         WHEN kind IN ('8','9','a') THEN [{'list': 'list1', 'salt': '1', 'action': 'add', 'verdict': 'block'}, {'list': 'list2', 'salt': '2', 'action': 'add', 'verdict': 'allow'}, {'list': 'list2', 'salt': '2', 'action': 'remove', 'verdict': 'allow'}]
         WHEN kind IN ('b','c') THEN [{'list': 'list2', 'salt': '2', 'action': 'add', 'verdict': 'allow'}] END) AS e FROM kinds)),
daily AS (SELECT list_id, key, day AS valid_from, max(CASE WHEN action = 'remove' THEN 0 WHEN verdict = 'block' THEN 2 ELSE 1 END) AS state FROM ev GROUP BY ALL),
spans AS (SELECT *, coalesce(lead(valid_from) OVER (PARTITION BY list_id, key ORDER BY valid_from), CAST('9999-12-31' AS DATE)) AS valid_to FROM daily),
steps AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS st, string_split(host, '.') AS lb FROM p WHERE host <> ''),
keys AS (
  SELECT page_id, 0 AS depth, host || path AS key, day FROM steps
  UNION ALL SELECT page_id, 1, host || '/' || st[1] || '/' || st[2] || '/', day FROM steps WHERE len(st) > 2
  UNION ALL SELECT page_id, 2, host || '/' || st[1] || '/', day FROM steps WHERE len(st) > 1
  UNION ALL SELECT page_id, 2 + i, array_to_string(lb[i:], '.'), day FROM (SELECT *, unnest(range(1, greatest(len(lb) - 1, 1) + 1)) AS i FROM steps)),
found AS (SELECT page_id, depth, k.key, max(CASE state WHEN 2 THEN 'block' ELSE 'allow' END) AS verdict
          FROM keys k JOIN spans s ON s.key = k.key AND s.state > 0 AND s.valid_from <= k.day AND k.day < s.valid_to GROUP BY ALL),
first AS (SELECT page_id, min_by(key, depth) AS rule, min_by(verdict, depth) AS verdict FROM found GROUP BY page_id)
SELECT p.page_id, p.url, p.day, f.rule, coalesce(f.verdict <> 'block', true) AS allowed FROM p LEFT JOIN first f USING (page_id)
"""


@query("op7_url_lists", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, events = lists_from_pages(load(spark, sf_dir, "pages").select("page_id", "url"))
    return judge_captures(captures, events)
