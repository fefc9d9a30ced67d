"""Resolve not-modified revisit records of web archives against the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeworks.llm.common import small, table
from cladeworks.session import settle

#: Headers of a not-modified answer that never replace stored ones (they describe the message, not the resource).
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "te", "trailer", "transfer-encoding", "upgrade")
#: Times of a URL from which on they are dealt to spans, and the number of these.
MOST_TIMES, SPANS = 10_000, 64
#: Most such URLs whose names or cuts are broadcast; those of more are joined by a shuffle.
MOST_HOT = 10_000


def canonical_url(url: Column) -> Column:
    """Without scheme, fragment, default port, leading www. or m., trailing slash and tracking parameters; host in lower case, parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^(www|m)[.]", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_replace(F.regexp_extract(bare, "[?](.*)$", 1), "(^|&)(utm_[^=&]*|ref)=[^&]*", "")
    query = F.array_join(F.array_sort(F.split(F.regexp_replace(query, "^&", ""), "&")), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _header(headers: Column, name: str) -> Column:
    return F.get(F.filter(headers, lambda h: h["name"] == name), F.lit(0))["value"]


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row for each revisit in ``records``.

    records: record_id long, url string, ts long, kind string ('response' or 'revisit'), headers
    array<struct<name, value>> with lower-case names. Other columns are ignored.

    Result: record_id, canonical_url, ts, refers_to (record_id of the latest response with an earlier ts; of those
    with one ts, the largest record_id), status, headers (null unless resolved). Status: ``resolved`` if the etag
    (weak or strong), or without one last-modified, is that of the response; ``validator_mismatch``;
    ``no_validator`` if the revisit has neither; ``no_response`` if there is no earlier one or the URL is null.
    Headers: those of the response, replaced and completed by those of the revisit that may be merged, by name.
    Repeated revisits are resolved each. Records whose ts is null count as revisits without a response, or are
    passed over as responses.

    Only the last response of each time of a URL matters, so these are aggregated before anything is ordered. The times
    of a URL with very many are dealt to spans between quantiles of its own times, and what earlier spans end with is
    found from one row a span. An empty table gives none; records without a URL or time meet no other.
    """
    rows = records.select("record_id", "ts", "kind", "headers", canonical_url(F.col("url")).alias("canonical_url"))
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "headers"))
    times = rows.where("canonical_url is not null and ts is not null").groupBy("canonical_url", "ts").agg(F.max(full).alias("full"))
    times = settle(times, "times")
    hot = small(times.groupBy("canonical_url").agg(F.count("*").alias("n")).where(F.col("n") > MOST_TIMES).select("canonical_url"), MOST_HOT, "hot-urls")
    some = not hot.isEmpty()
    if some:
        cuts = F.percentile_approx("ts", [i / SPANS for i in range(1, SPANS)], 100 * SPANS).alias("cuts")
        cuts = small(times.join(hot, "canonical_url", "left_semi").groupBy("canonical_url").agg(cuts), MOST_HOT, "cuts")
        times = times.join(cuts, "canonical_url", "left").withColumn("span", F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("ts"))), F.lit(0))).drop("cuts")
    else:
        times = times.withColumn("span", F.lit(0))
    earlier = Window.partitionBy("canonical_url", "span").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    times = times.withColumn("response", F.max("full").over(earlier))
    if some:
        spans = times.join(hot, "canonical_url", "left_semi").groupBy("canonical_url", "span").agg(F.max("full").alias("full"))
        before = Window.partitionBy("canonical_url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
        spans = spans.select("canonical_url", "span", F.max("full").over(before).alias("carried"))
        times = times.join(spans, ["canonical_url", "span"], "left").withColumn("response", F.coalesce("response", "carried"))
    found = rows.where("kind = 'revisit'").join(times.select("canonical_url", "ts", "response"), ["canonical_url", "ts"], "left")
    strong = lambda c: F.regexp_replace(c, "^W/", "")
    etag, date = _header(F.col("headers"), "etag"), _header(F.col("headers"), "last-modified")
    known, theirs = F.col("response.headers"), lambda n: _header(F.col("response.headers"), n)
    same = F.when(etag.isNotNull(), F.coalesce(strong(etag) == strong(theirs("etag")), F.lit(False))).when(date.isNotNull(), F.coalesce(date == theirs("last-modified"), F.lit(False)))
    status = F.when(F.col("response").isNull(), "no_response").when(same.isNull(), "no_validator").when(same, "resolved").otherwise("validator_mismatch")
    new = F.filter(F.coalesce("headers", F.array().cast("array<struct<name:string,value:string>>")), lambda h: ~h["name"].isin(*NOT_MERGED))
    names = F.transform(new, lambda h: h["name"])
    merged = F.array_sort(F.concat(F.filter(known, lambda h: ~F.array_contains(names, h["name"])), new))
    return found.select(
        "record_id", "canonical_url", "ts", F.col("response.record_id").alias("refers_to"), status.alias("status"), F.when(status == "resolved", merged).alias("headers")
    )


def page_records(pages: DataFrame) -> DataFrame:
    """Records derived from ``pages``: each page is a response, and is asked for again some time later."""
    tag = F.concat(F.lit('"'), F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary")), F.lit('"'))
    seen = (F.col("page_id") * 10).alias("ts")
    day = F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string"))
    head = lambda *kv: F.filter(F.array(*(F.struct(F.lit(k).alias("name"), v.cast("string").alias("value")) for k, v in kv)), lambda h: h["value"].isNotNull())
    size = F.length(F.coalesce("html", F.lit("")))
    full = head(("cache-control", F.lit("max-age=60")), ("content-length", size), ("content-type", F.lit("text/html")), ("etag", tag), ("last-modified", day))
    again = head(
        ("age", F.lit("0")), ("cache-control", F.concat(F.lit("max-age="), F.col("page_id") % 600)), ("content-length", F.lit("0")),
        ("etag", F.when(F.col("page_id") % 5 != 0, F.concat(F.when(F.col("page_id") % 2 == 0, "W/").otherwise(""), tag))),
        ("last-modified", F.when((F.col("page_id") % 5 != 0) | (F.col("page_id") % 3 != 0), day)),
    )
    later = (F.col("page_id") * 10 + 1000 + 977 * (F.col("page_id") % 50)).alias("ts")
    row = lambda kind, ts, headers: F.struct(ts, F.lit(kind).alias("kind"), headers.alias("headers"))
    both = F.explode(F.array(row("response", seen, full), row("revisit", later, again))).alias("r")
    return pages.select(F.col("page_id").alias("record_id"), "url", both).select("record_id", "url", "r.*")


def op5_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each revisit derived from the pages refers to; cases as in ``resolve_revisits``."""
    found = resolve_revisits(page_records(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "; ")
    return found.select("record_id", "canonical_url", "ts", "refers_to", "status", lines.alias("headers"))


OP5_SQL = r"""
WITH b AS (SELECT page_id, md5(coalesce(html, '')) AS h, length(coalesce(html, '')) AS n, url,
    regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS bare FROM pages),
q AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*', 0)), ':(80|443)$', ''), '^(www|m)[.]', '') AS host,
    regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(string_split(regexp_replace(regexp_replace(regexp_extract(bare, '[?](.*)$', 1), '(^|&)(utm_[^=&]*|ref)=[^&]*', '', 'g'), '^&', ''), '&')), '&') AS query FROM b),
u AS (SELECT *, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS c FROM q),
r AS (SELECT c, page_id * 10 AS t, max(page_id) AS id FROM u WHERE c IS NOT NULL GROUP BY 1, 2),
v AS (SELECT page_id, c, page_id * 10 + 1000 + 977 * (page_id % 50) AS t, h,
    page_id % 5 <> 0 AS has_tag, page_id % 5 <> 0 OR page_id % 3 <> 0 AS has_date FROM u),
j AS (SELECT v.*, r.id AS ref FROM v ASOF LEFT JOIN r ON v.c = r.c AND v.t > r.t),
s AS (SELECT j.*, w.h AS wh, w.n AS wn, CASE WHEN ref IS NULL THEN 'no_response' WHEN has_tag THEN CASE WHEN j.h = w.h THEN 'resolved' ELSE 'validator_mismatch' END
    WHEN has_date THEN CASE WHEN j.page_id % 28 = ref % 28 THEN 'resolved' ELSE 'validator_mismatch' END ELSE 'no_validator' END AS status
    FROM j LEFT JOIN u w ON w.page_id = ref)
SELECT page_id AS record_id, c AS canonical_url, t AS ts, ref AS refers_to, status, CASE WHEN status = 'resolved' THEN
    'age: 0; cache-control: max-age=' || (page_id % 600) || '; content-length: ' || wn || '; content-type: text/html; etag: ' ||
    CASE WHEN NOT has_tag THEN '"' || wh || '"' WHEN page_id % 2 = 0 THEN 'W/"' || h || '"' ELSE '"' || h || '"' END ||
    '; last-modified: day ' || CASE WHEN has_date THEN page_id % 28 ELSE ref % 28 END END AS headers FROM s
"""
