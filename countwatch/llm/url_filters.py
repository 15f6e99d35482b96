"""URL filters by a temporal list join (operator 2).

Lists are dated: an entry is added to a list for a host or a path prefix and may be removed and added again.
Entries become validity intervals [valid_from, valid_to), and every capture is evaluated against the entries
that were active when it was fetched, not against today's list.

A capture's URL gives its lookup keys: the host and its parent domains, and the host with each path prefix.
Keys meet intervals by an as-of join: equality on key and time bucket, then the interval test. Intervals are
cut at bucket borders for that, so neither a key that holds a third of all captures nor one that holds a third
of all entries makes a group: its rows spread over buckets, and the join may be split further where it is
skewed. Of the active entries the most specific decides (path before host, longer before shorter), allow
before block, then the list's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from countwatch.llm.common import table

#: Length of a time bucket in seconds.
BUCKET = 30 * 86_400
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?(/[^?#]*)?"
#: A path prefix is more specific than any host.
PATH_RANK = 1000


def host_of(url: Column) -> Column:
    """Lower-case host without user, port or last dot; null if there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, URL, 1)), r"\.+$", "")
    return F.when(F.length(host) > 0, host)


def segments_of(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, URL, 2), "/"), lambda s: s != "")


def lookup_keys(url: Column) -> Column:
    """array of (key, rank): parent domains of two labels or more (or the single label), then path prefixes."""
    labels, segments = F.split(host_of(url), r"\."), segments_of(url)
    n = F.size(labels)
    hosts = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct(F.array_join(F.slice(labels, i, n), ".").alias("key"), (n - i + 1).alias("rank")))
    paths = F.transform(
        F.when(F.size(segments) > 0, F.sequence(F.lit(1), F.size(segments))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")).alias("key"), (i + PATH_RANK).alias("rank")),
    )
    return F.when(host_of(url).isNotNull(), F.concat(hosts, paths))


def normal_pattern(pattern: Column) -> Column:
    """The host part in lower case; a path keeps its case, as the paths of URLs do."""
    host = F.substring_index(pattern, "/", 1)
    return F.concat(F.lower(host), F.substr(pattern, F.length(host) + 1))


def validity_intervals(entries: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(list_name, pattern, action, valid_from, valid_to): when each added entry was active; null: still is.

    ``entries`` has list_name, pattern, action, change (add or remove) and at (seconds). Each change holds until
    the next one of the same list and pattern; of changes at one time a removal comes last, then the larger
    action. Rows without list, pattern or time are no entries; equal rows count once. The next change is
    looked up inside a time bucket, and beyond it through the first change of each later bucket, so a pattern
    with very many changes is not one group.
    """
    rows = entries.where("list_name is not null and pattern is not null and at is not null").select("list_name", normal_pattern(F.col("pattern")).alias("pattern"), "action", "change", "at").distinct()
    rows = rows.withColumn("bucket", F.floor(F.col("at") / bucket))
    key = ["list_name", "pattern"]
    inside = Window.partitionBy(*key, "bucket").orderBy("at", F.when(F.col("change") == "remove", 1).otherwise(0), "action")
    later = rows.groupBy(*key, "bucket").agg(F.min("at").alias("first_at"))
    later = later.withColumn("later_at", F.lead("first_at").over(Window.partitionBy(*key).orderBy("bucket"))).drop("first_at")
    return (
        rows.withColumn("next_at", F.lead("at").over(inside))
        .join(later, [*key, "bucket"])
        .select(*key, "action", "change", F.col("at").alias("valid_from"), F.coalesce("next_at", "later_at").alias("valid_to"))
        .where("change = 'add' and (valid_to is null or valid_to > valid_from)")
        .drop("change")
    )


def evaluate(captures: DataFrame, entries: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(page_id, url, fetched_s, verdict, pattern, list_name) for each capture (page_id, url, fetched_s).

    verdict is block or allow by the deciding entry, pass without one, unparsed for a URL without host or a
    null one, undated without a fetch time. Repeated captures stay repeated. Empty lists let all pass.
    """
    own = captures.select("page_id", "url", F.col("fetched_s").cast("long").alias("fetched_s")).groupBy("page_id", "url", "fetched_s").agg(F.count("*").alias("times"))
    keyed = own.select("*", F.explode_outer(lookup_keys(F.col("url"))).alias("k")).select("page_id", "url", "fetched_s", "times", F.col("k.key").alias("pattern"), F.col("k.rank").alias("rank"), F.floor(F.col("fetched_s") / bucket).alias("bucket"))
    # An entry that is still active reaches to the last capture; one row.
    last = captures.agg(F.max("fetched_s").cast("long").alias("m")).first()["m"] or 0
    spans = validity_intervals(entries, bucket).where(F.col("valid_from") <= last)
    until = F.least(F.coalesce(F.col("valid_to") - 1, F.lit(last)), F.lit(last))
    spans = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("valid_from") / bucket), F.floor(until / bucket))))
    active = (F.col("fetched_s") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_s") < F.col("valid_to")))
    met = keyed.join(spans.withColumnRenamed("pattern", "listed"), (F.col("pattern") == F.col("listed")) & (keyed["bucket"] == spans["bucket"]) & active, "left")
    # Smallest order first: most specific, allow, name of the list.
    order = F.when(F.col("action").isNotNull(), F.struct((-F.col("rank")).alias("a"), F.when(F.col("action") == "allow", 0).otherwise(1).alias("b"), F.col("list_name").alias("list_name"), F.col("action").alias("action"), F.col("listed").alias("pattern")))
    best = met.groupBy("page_id", "url", "fetched_s", "times").agg(F.min(order).alias("best"))
    verdict = F.when(host_of(F.col("url")).isNull(), "unparsed").when(F.col("fetched_s").isNull(), "undated").otherwise(F.coalesce("best.action", F.lit("pass")))
    return best.select(
        "page_id", "url", "fetched_s", verdict.alias("verdict"), F.col("best.pattern").alias("pattern"), F.col("best.list_name").alias("list_name"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"),
    ).drop("copy")


START = 1_704_067_200
DAY = 86_400


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time inside thirty days, spread by the page's number."""
    return pages.select("page_id", "url", (F.lit(START) + F.pmod(F.col("page_id") * 7919, F.lit(30 * DAY))).cast("long").alias("fetched_s"))


def lists_of(pages: DataFrame) -> DataFrame:
    """Dated lists over the pages' own hosts, sections (first path segment) and zones (last two labels)."""
    urls = pages.select(host_of(F.col("url")).alias("host"), segments_of(F.col("url"))[0].alias("section")).where("host is not null").distinct()

    def digits(c: Column) -> Column:
        return F.conv(F.substring(F.md5(c), 1, 2), 16, 10).cast("int")

    def entry(name: str, pattern: Column, action: Column, change: str, day: Column) -> Column:
        return F.struct(F.lit(name).alias("list_name"), pattern.alias("pattern"), action.alias("action"), F.lit(change).alias("change"), (F.lit(START) + day * DAY).cast("long").alias("at"))

    block = F.lit("block")
    host, h = F.col("host"), digits(F.col("host"))
    section = F.concat_ws("/", "host", "section")
    s = digits(section)
    zone = F.substring_index("host", ".", -2)
    hosts = urls.select("host").distinct().select(F.explode(F.array(
        entry("hosts", host, block, "add", h % 20), entry("hosts", host, block, "remove", h % 20 + 2 + h % 5), entry("hosts", host, block, "add", h % 20 + 9 + h % 3),
    )).alias("e"))
    act = F.when(s % 2 == 0, "allow").otherwise("block")
    sections = urls.where("section is not null").select(F.explode(F.array(entry("sections", section, act, "add", s % 25), entry("sections", section, act, "remove", s % 25 + 1 + s % 9))).alias("e"))
    zones = urls.select(zone.alias("zone")).distinct().select(entry("zones", F.col("zone"), block, "add", digits(F.col("zone")) % 10 + 18).alias("e"))
    return hosts.unionByName(sections).unionByName(zones).select("e.*")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page evaluated against the lists of its fetch time."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return evaluate(captures_of(pages), lists_of(pages))


OP2_SQL = r"""
WITH u AS (
  SELECT page_id, url, 1704067200 + (page_id * 7919) % 2592000 AS fetched_s,
         nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?(/[^?#]*)?', 1)), '\.+$', ''), '') AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?(/[^?#]*)?', 2), '/'), lambda s: s <> '') AS seg
  FROM pages),
hosts AS (SELECT DISTINCT host FROM u WHERE host IS NOT NULL),
hd AS (SELECT host, CAST('0x' || substr(md5(host), 1, 2) AS INTEGER) AS h FROM hosts),
secs AS (SELECT DISTINCT host || '/' || seg[1] AS p FROM u WHERE host IS NOT NULL AND len(seg) > 0),
sd AS (SELECT p, CAST('0x' || substr(md5(p), 1, 2) AS INTEGER) AS s FROM secs),
zs AS (SELECT DISTINCT array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS z FROM hosts),
e AS (
  SELECT 'hosts' AS list_name, host AS pattern, 'block' AS action, 'add' AS change, 1704067200 + 86400 * (h % 20) AS at FROM hd
  UNION SELECT 'hosts', host, 'block', 'remove', 1704067200 + 86400 * (h % 20 + 2 + h % 5) FROM hd
  UNION SELECT 'hosts', host, 'block', 'add', 1704067200 + 86400 * (h % 20 + 9 + h % 3) FROM hd
  UNION SELECT 'sections', p, CASE WHEN s % 2 = 0 THEN 'allow' ELSE 'block' END, 'add', 1704067200 + 86400 * (s % 25) FROM sd
  UNION SELECT 'sections', p, CASE WHEN s % 2 = 0 THEN 'allow' ELSE 'block' END, 'remove', 1704067200 + 86400 * (s % 25 + 1 + s % 9) FROM sd
  UNION SELECT 'zones', z, 'block', 'add', 1704067200 + 86400 * (CAST('0x' || substr(md5(z), 1, 2) AS INTEGER) % 10 + 18) FROM zs),
met AS (
  SELECT u.page_id, u.url, u.fetched_s, e.*,
         CASE WHEN contains(e.pattern, '/') THEN 1000 + len(string_split(e.pattern, '/')) - 1 ELSE len(string_split(e.pattern, '.')) END AS rank,
         row_number() OVER (PARTITION BY u.page_id, u.url, u.fetched_s, e.list_name, e.pattern ORDER BY e.at DESC, e.change DESC, e.action DESC) AS newest
  FROM (SELECT DISTINCT page_id, url, fetched_s, host, seg FROM u WHERE host IS NOT NULL) u
  JOIN e ON e.at <= u.fetched_s AND e.pattern IN (u.host, array_to_string(list_slice(string_split(u.host, '.'), -2, -1), '.'), u.host || '/' || seg[1])),
best AS (
  SELECT *, row_number() OVER (PARTITION BY page_id, url, fetched_s ORDER BY rank DESC, action, list_name) AS place
  FROM met WHERE newest = 1 AND change = 'add')
SELECT u.page_id, u.url, u.fetched_s, CASE WHEN u.host IS NULL THEN 'unparsed' ELSE coalesce(b.action, 'pass') END AS verdict, b.pattern, b.list_name
FROM u LEFT JOIN best b ON b.place = 1 AND b.page_id = u.page_id AND b.url = u.url AND b.fetched_s = u.fetched_s
"""
