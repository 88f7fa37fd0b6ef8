"""URL filter by dated lists, in DataFrame functions only.

A list is a history of entries (pattern, day, active): from that day on the
pattern is on the list, or off it. ``intervals`` turns the history into
validity intervals [since, until); ``as_of`` evaluates every capture against
the interval of its host, or of a parent domain of it, that holds at its fetch
day. Of several active patterns the longest names the match.

A hot host costs no task more than its share: captures are reduced to distinct
(host, day) pairs before the list is met, and the way back is a plain join that
adaptive execution splits.

Defined results: a null, empty or host-less URL has the empty host and is never
blocked; a null fetch day matches no interval. Two entries of a pattern on one
day: the active one holds. Repeated captures are each answered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stage import table

HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, since, until (null: still) of every active stretch of the history."""
    day = entries.where("pattern is not null and day is not null").groupBy("pattern", "day").agg(F.max("active").alias("active"))
    w = Window.partitionBy("pattern").orderBy("day")
    return (day.withColumn("until", F.lead("day").over(w)).where("active")
            .select("pattern", F.col("day").alias("since"), "until"))


def suffixes(name):
    """The host and its parent domains."""
    parts = F.split(name, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def as_of(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (any columns, among them host and day) with blocked, pattern, since."""
    seen = captures.select("host", "day").where("host <> '' and day is not null").distinct()
    tried = seen.select("host", "day", F.explode(suffixes(F.col("host"))).alias("pattern"))
    active = (tried.join(intervals(entries), "pattern")
              .where((F.col("day") >= F.col("since")) & (F.col("until").isNull() | (F.col("day") < F.col("until")))))
    best = (active.groupBy("host", "day").agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", "since")).alias("m"))
            .select("host", "day", F.col("m.pattern").alias("pattern"), F.col("m.since").alias("since")))
    return captures.join(best, ["host", "day"], "left").withColumn("blocked", F.col("pattern").isNotNull())


def _code(text, at: int):
    return F.conv(F.substring(F.md5(text), at, 4), 16, 10).cast("long")


def history(pages: DataFrame) -> DataFrame:
    """A list history derived from the hosts of the pages: about a third of the hosts are
    listed at some day, half of those taken off later and some listed once more; some
    registered domains (the last two labels) are listed as a whole for a while."""
    own = pages.select(host(F.col("url")).alias("pattern")).where("pattern <> ''").distinct()
    parent = (own.select(F.substring_index("pattern", ".", -3).alias("pattern")).distinct()
              .where(_code(F.col("pattern"), 13) % 5 == 0).select("pattern", (_code(F.col("pattern"), 17) % 300).alias("day")))
    listed = own.where(_code(F.col("pattern"), 1) % 3 == 0).select("pattern", (_code(F.col("pattern"), 5) % 300).alias("day"))
    gap = _code(F.col("pattern"), 9)
    off = listed.where(gap % 2 == 0).select("pattern", (F.col("day") + 1 + gap % 90).alias("day"))
    again = listed.where(gap % 4 == 0).select("pattern", (F.col("day") + 101 + gap % 60).alias("day"))
    rows = [(listed, True), (off, False), (again, True), (parent, True), (parent.select("pattern", (F.col("day") + 30).alias("day")), False)]
    out = None
    for part, active in rows:
        part = part.select("pattern", "day", F.lit(active).alias("active"))
        out = part if out is None else out.union(part)
    return out


def op4_temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its host, fetch day (from its id) and the list entry active then."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.select("page_id", host(F.col("url")).alias("host"), F.pmod(F.col("page_id") * 37, F.lit(400)).alias("day"))
    return as_of(captures, history(pages)).select("page_id", "host", "day", "blocked", "pattern", "since")


OP4_SQL = r"""
WITH cap AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
         ((page_id * 37) % 400 + 400) % 400 AS day
  FROM pages),
own AS (SELECT DISTINCT host AS pattern, md5(host) AS m FROM cap WHERE host <> ''),
code AS (SELECT pattern, ('0x' || substr(m, 1, 4))::BIGINT AS c1, ('0x' || substr(m, 5, 4))::BIGINT AS c5,
                ('0x' || substr(m, 9, 4))::BIGINT AS gap FROM own),
listed AS (SELECT pattern, c5 % 300 AS day, gap FROM code WHERE c1 % 3 = 0),
top AS (SELECT DISTINCT array_to_string(list_slice(p, greatest(len(p) - 2, 1), len(p)), '.') AS pattern
        FROM (SELECT string_split(pattern, '.') AS p FROM own)),
parent AS (SELECT pattern, ('0x' || substr(md5(pattern), 17, 4))::BIGINT % 300 AS day FROM top
           WHERE ('0x' || substr(md5(pattern), 13, 4))::BIGINT % 5 = 0),
hist AS (
  SELECT pattern, day, true AS active FROM listed
  UNION ALL SELECT pattern, day + 1 + gap % 90, false FROM listed WHERE gap % 2 = 0
  UNION ALL SELECT pattern, day + 101 + gap % 60, true FROM listed WHERE gap % 4 = 0
  UNION ALL SELECT pattern, day, true FROM parent
  UNION ALL SELECT pattern, day + 30, false FROM parent),
one AS (SELECT pattern, day, bool_or(active) AS active FROM hist GROUP BY pattern, day),
iv AS (SELECT * FROM (SELECT pattern, day AS since, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS until, active FROM one) WHERE active),
seen AS (SELECT DISTINCT host, day FROM cap WHERE host <> ''),
part AS (SELECT host, day, string_split(host, '.') AS p FROM seen),
tried AS (SELECT host, day, array_to_string(list_slice(p, i, len(p)), '.') AS pattern
          FROM (SELECT host, day, p, unnest(range(1, len(p) + 1)) AS i FROM part)),
hit AS (SELECT t.host, t.day, t.pattern, iv.since,
               row_number() OVER (PARTITION BY t.host, t.day ORDER BY length(t.pattern) DESC, t.pattern DESC, iv.since DESC) AS r
        FROM tried t JOIN iv ON t.pattern = iv.pattern AND t.day >= iv.since AND (iv.until IS NULL OR t.day < iv.until))
SELECT cap.page_id, cap.host, cap.day, hit.pattern IS NOT NULL AS blocked, hit.pattern, hit.since
FROM cap LEFT JOIN hit ON cap.host = hit.host AND cap.day = hit.day AND hit.r = 1
"""
