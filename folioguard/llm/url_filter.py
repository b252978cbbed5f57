"""Operator 4: URL filters with a dated list, as a temporal join.

A dated list has entries (domain, at, action): from ``at`` on, the domain and all hosts below it are
blocked or allowed. Entries become validity intervals, each ending where the domain's next one
starts. A capture (host, time) is evaluated against the entries active at its time: of the host's own
domain and all its parents, the most specific active entry decides.

The as-of join is an equality join on (domain, time bucket) with the interval as residual: an
interval is listed under each bucket of ``bucket_days`` that it touches (the last one is open-ended
and listed up to the last capture), so a capture meets at most the entries of its own bucket. A host
with a third of all captures is one key among its buckets; captures are therefore first reduced to
distinct (host, time) with partial aggregation, and decisions are joined back by host and time.

Null urls, urls without a host, and captures without a time are kept and never blocked. Entries with
a null domain, time or action are ignored; of entries of one domain at the same time, 'block' wins.
Columns of the input with clashing names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioguard.llm.common import read_table

BUCKET_DAYS = 30


def url_host(url: Column) -> Column:
    """The host in lower case, without user, port and trailing dot; null if there is none."""
    return F.nullif(F.rtrim(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(".")), F.lit(""))


def domains(host: Column) -> Column:
    """The host and its parents, longest first: a.b.c, b.c, c."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """domain, action, since, until (null: open) of each entry that changes something; as timestamps."""
    e = entries.where("domain is not null and at is not null and action is not null")
    e = e.groupBy(F.lower("domain").alias("domain"), F.col("at").cast("timestamp").alias("since")).agg(F.max("action").alias("action"))
    return e.withColumn("until", F.lead("since").over(Window.partitionBy("domain").orderBy("since")))


def filter_urls(captures: DataFrame, entries: DataFrame, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """``captures`` (capture_id, url, at) with host, day, domain and action of the deciding entry, since (a timestamp), and blocked."""
    c = captures.select("capture_id", url_host(F.col("url")).alias("host"), F.col("at").cast("timestamp").alias("at"))
    bucket = lambda t: F.floor(F.unix_date(F.to_date(t)) / bucket_days).cast("int")
    visits = c.where("host is not null and at is not null").groupBy("host", "at").agg(F.count("*").alias("captures"))
    last = visits.agg(F.max("at").alias("last"))
    v = intervals(entries).crossJoin(F.broadcast(last)).where(F.col("since") <= F.col("last"))
    until = F.least(F.coalesce(F.col("until") - F.expr("INTERVAL '0.000001' SECOND"), F.col("last")), F.col("last"))
    v = v.withColumn("bucket", F.explode(F.sequence(bucket(F.col("since")), bucket(until)))).drop("last")
    asked = visits.select("host", "at", bucket(F.col("at")).alias("bucket"), F.posexplode(domains(F.col("host"))).alias("rank", "domain"))
    met = asked.join(v, ["domain", "bucket"]).where((F.col("at") >= F.col("since")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))))
    decided = met.groupBy("host", "at").agg(F.min_by(F.struct("domain", "action", "since"), "rank").alias("e"))
    # Rows without a host or a time would share one key of the join, so they go around it.
    whole = F.col("host").isNotNull() & F.col("at").isNotNull()
    out = c.where(whole).join(decided, ["host", "at"], "left").unionByName(c.where(~whole), allowMissingColumns=True)
    day = F.to_date("at").alias("day")
    return out.select("capture_id", "host", day, F.col("e.domain").alias("domain"), F.col("e.action").alias("action"), F.col("e.since").alias("since"), F.coalesce(F.col("e.action") == "block", F.lit(False)).alias("blocked"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch day of a page: 2023-01-01 plus page_id modulo 730 days."""
    pages = read_table(spark, sf_dir, "pages")
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", F.date_add(F.lit("2023-01-01").cast("date"), F.pmod("page_id", F.lit(730)).cast("int")).alias("at"))
    hosts = pages.select(F.explode(domains(url_host(F.col("url")))).alias("domain"))
    listed = hosts.distinct().where("length(domain) % 2 = 0").withColumn("k", F.explode(F.array(*(F.lit(k) for k in range(3)))))
    entries = listed.select(
        "domain",
        F.date_add(F.lit("2023-01-01").cast("date"), (F.length("domain") * 37 + F.col("k") * 101) % 700).alias("at"),
        F.when((F.length("domain") + F.col("k")) % 3 == 0, "allow").otherwise("block").alias("action"),
    )
    out = filter_urls(captures, entries).withColumn("since", F.to_date("since").cast("string"))
    return out.select(F.col("capture_id").alias("page_id"), "host", F.col("day").cast("string").alias("day"), "domain", "action", "since", "blocked")


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.'), '') AS host,
         CAST(DATE '2023-01-01' + CAST(page_id % 730 AS INTEGER) AS DATE) AS day
  FROM pages),
s AS (SELECT DISTINCT host, i, array_to_string(parts[i:], '.') AS domain
      FROM (SELECT host, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT DISTINCT host, string_split(host, '.') AS parts FROM p WHERE host IS NOT NULL))),
e AS (SELECT domain, CAST(DATE '2023-01-01' + CAST((length(domain) * 37 + k * 101) % 700 AS INTEGER) AS DATE) AS since,
             CASE WHEN (length(domain) + k) % 3 = 0 THEN 'allow' ELSE 'block' END AS action
      FROM (SELECT DISTINCT domain FROM s WHERE length(domain) % 2 = 0) CROSS JOIN (SELECT unnest([0, 1, 2]) AS k)),
g AS (SELECT domain, since, max(action) AS action FROM e GROUP BY domain, since),
v AS (SELECT *, lead(since) OVER (PARTITION BY domain ORDER BY since) AS until FROM g),
m AS (SELECT p.page_id, v.domain, v.action, v.since, row_number() OVER (PARTITION BY p.page_id ORDER BY s.i) AS r
      FROM p JOIN s USING (host) JOIN v ON v.domain = s.domain AND p.day >= v.since AND (v.until IS NULL OR p.day < v.until))
SELECT p.page_id, host, CAST(day AS VARCHAR) AS day, m.domain, m.action, CAST(m.since AS VARCHAR) AS since, coalesce(m.action = 'block', false) AS blocked
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.r = 1
"""
