"""URL filters: dated list entries as validity intervals, and an as-of join of captures with them.

Entries of a list say on which date a key (a host, a parent domain, or host and path) was added or removed.
A key's state holds from one date to the next. Intervals are cut by months, so that a capture meets at most
the changes of one month of each of its keys by an equi-join on key and month; a popular host is an ordinary
skewed join key, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, since, until) in which a key is listed; until is null while it is.

    entries: list, key, action ("add" or "remove"), listed_on (date). Entries with a null are ignored; keys are
    the same whatever their case; several entries of one date count as one, a removal if any of them is. So a
    key has a row for a date at most.
    """
    dated = entries.where("list is not null and key is not null and listed_on is not null and action in ('add', 'remove')")
    dated = dated.withColumn("key", F.lower("key"))
    dated = dated.groupBy("list", "key", "listed_on").agg(F.max("action").alias("action"))
    w = Window.partitionBy("list", "key").orderBy("listed_on")
    changes = dated.withColumn("before", F.lag("action").over(w)).where("before is null or before != action")
    spans = changes.withColumn("until", F.lead("listed_on").over(w)).where("action = 'add'")
    return spans.select("list", "key", F.col("listed_on").alias("since"), "until")


#: Blanks and controls around a URL; what comes before the host; the host after a user's name; the path. A backslash is a slash.
_EDGES = r"^[\x00-\x20]+|[\x00-\x20]+$"
_BEFORE = r"^(https?:[/\\]*|[a-z][a-z0-9+.-]*:[/\\]{2,}|[/\\]{2,})"
_HOST = r"^(?:[^/?#\\]*@)?([^/?#\\:@]*)"
_PATH = r"^[^/?#\\]*([/\\][^?#]*)?"


def url_keys(url):
    """Keys that an entry may have for a URL: host and path, the host and its parent domains of two labels or more.

    Letters are lower case and a host has no dot at its end. Escapes and international names are as written.
    """
    bare = F.regexp_replace(F.lower(F.regexp_replace(url, _EDGES, "")), _BEFORE, "")
    host = F.regexp_replace(F.regexp_extract(bare, _HOST, 1), r"[.]+$", "")
    path = F.replace(F.regexp_extract(bare, _PATH, 1), F.lit("\\"), F.lit("/"))
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.array_distinct(F.concat(F.array(F.concat(host, path)), parents))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """All columns of captures and blocked, matched_list, matched_key, listed_since, of the state on the day of fetched_at.

    The longest key that is listed then is named, of equal ones that of the first list. Different pairs of URL and
    day are judged once, and those that are blocked meet the captures by an equi-join, so other columns travel
    once and rows need no number.

    Cases: a null url or fetched_at, or an empty url, is not blocked (nulls); repeated captures are judged
    each; URLs of any length are; an empty list blocks nothing. Columns with the names of new ones are replaced.
    """
    new = ("blocked", "matched_list", "matched_key", "listed_since")
    captures = captures.drop(*new)
    asked = captures.select(F.col("url").alias("u"), F.to_date("fetched_at").alias("day")).where("u is not null and day is not null").distinct()
    last = asked.agg(F.max("day").alias("last"))
    month = lambda d: F.year(d) * 12 + F.month(d)
    spans = intervals(entries).crossJoin(F.broadcast(last)).where("since <= last")
    spans = spans.withColumn("month", F.explode(F.sequence(month("since"), month(F.least(F.coalesce(F.date_sub("until", 1), "last"), "last")))))
    keyed = asked.withColumn("key", F.explode(url_keys(F.col("u")))).withColumn("month", month("day"))
    on = (keyed.key == spans.key) & (keyed.month == spans.month) & (keyed.day >= spans.since) & (spans.until.isNull() | (keyed.day < spans.until))
    met = keyed.join(spans, on).select("u", "day", F.struct((-F.length(spans.key)).alias("n"), spans.key.alias("key"), spans.list.alias("list"), spans.since.alias("since")).alias("m"))
    best = met.groupBy("u", "day").agg(F.min("m").alias("__m")).select(F.col("u").alias("__u"), F.col("day").alias("__day"), "__m")
    out = captures.join(best, (captures["url"] == best["__u"]) & (F.to_date(captures["fetched_at"]) == best["__day"]), "left")
    return out.select(*captures.columns, F.col("__m").isNotNull().alias("blocked"), F.col("__m.list").alias("matched_list"), F.col("__m.key").alias("matched_key"), F.col("__m.since").alias("listed_since"))


# --- the query: captures and entries derived by rule from pages, as there are no such tables

_HEX = "instr('0123456789abcdef', substr({x}, {i}, 1)) - 1"


def demo_sql(spark_sql: bool) -> tuple[str, str]:
    """SELECTs of captures and entries over pages, for Spark or DuckDB.

    A page is fetched on day page_id * 7919 mod 360 of 2024. Of hosts and of parent domains those whose MD5
    begins with a digit below 8 are added to a list on some day and, half of them, removed later.
    """
    day = (lambda n: f"date_add(DATE'2024-01-01', cast({n} AS INT))") if spark_sql else (lambda n: f"(DATE '2024-01-01' + cast({n} AS INT))")
    host = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1))"
    h = lambda i: "(" + _HEX.format(x="md5(key)", i=i) + ")"
    captures = f"SELECT page_id, url, {day('(page_id * 7919) % 360')} AS fetched_at FROM pages"
    keys = f"SELECT DISTINCT {host} AS key FROM pages UNION SELECT DISTINCT regexp_replace({host}, '^[^.]*[.]', '') FROM pages"
    add = f"SELECT 'list' || {h(5)} % 3 AS list, key, 'add' AS action, {day(f'{h(2)} * 16')} AS listed_on FROM keys WHERE {h(1)} < 8"
    remove = f"SELECT 'list' || {h(5)} % 3 AS list, key, 'remove' AS action, {day(f'{h(2)} * 16 + {h(3)} * 8')} AS listed_on FROM keys WHERE {h(1)} < 8 AND {h(4)} < 8"
    again = f"SELECT 'list' || {h(5)} % 3 AS list, key, 'add' AS action, {day(f'{h(2)} * 16 + {h(3)} * 12 + 7')} AS listed_on FROM keys WHERE {h(1)} < 3"
    return captures, f"WITH keys AS ({keys}) {add} UNION ALL {remove} UNION ALL {again}"


def op2_urls(spark, sf_dir: str) -> DataFrame:
    from linkrain.llm.common import table

    captures, entries = demo_sql(True)
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    run = lambda q: spark.sql(q.replace("FROM pages", "FROM {pages}"), pages=pages)
    return filter_urls(run(captures), run(entries))


def _oracle() -> str:
    captures, entries = demo_sql(False)
    return f"""
    WITH captures AS (SELECT row_number() OVER () AS r, * FROM ({captures})),
    entries AS (SELECT list, key, listed_on, max(action) AS action FROM ({entries}) WHERE key IS NOT NULL GROUP BY ALL),
    bare AS (SELECT r, regexp_replace(lower(regexp_replace(url, '{_EDGES}', '', 'g')), '{_BEFORE}', '') AS b FROM captures),
    parts AS (SELECT r, regexp_replace(regexp_extract(b, '{_HOST}', 1), '[.]+$', '') AS host, replace(regexp_extract(b, '{_PATH}', 1), chr(92), '/') AS path FROM bare),
    labels AS (SELECT r, host, path, string_split(host, '.') AS l FROM parts),
    keyed AS (
      SELECT r, host || path AS key FROM labels
      UNION SELECT r, array_to_string(l[i:], '.') FROM (SELECT r, l, unnest(range(1, greatest(2, len(l)))) AS i FROM labels)),
    state AS (
      SELECT k.r, k.key, e.list, arg_max(e.action, e.listed_on) AS action, c.fetched_at AS day
      FROM keyed k JOIN captures c USING (r) JOIN entries e ON e.key = k.key AND e.listed_on <= c.fetched_at GROUP BY ALL),
    listed AS (
      SELECT s.r, s.key, s.list, min(e.listed_on) AS since
      FROM state s JOIN entries e ON e.key = s.key AND e.list = s.list AND e.action = 'add' AND e.listed_on <= s.day
        AND e.listed_on > coalesce((SELECT max(x.listed_on) FROM entries x WHERE x.key = s.key AND x.list = s.list AND x.action = 'remove' AND x.listed_on <= s.day), DATE '1900-01-01')
      WHERE s.action = 'add' GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length(key) DESC, key, list) AS place FROM listed)
    SELECT page_id, url, fetched_at, best.r IS NOT NULL AS blocked, list AS matched_list, key AS matched_key, since AS listed_since
    FROM captures LEFT JOIN (SELECT * FROM best WHERE place = 1) AS best USING (r)
    """


ORACLE_SQL = _oracle()
