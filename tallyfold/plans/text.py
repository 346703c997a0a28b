"""Counting, text, latency and HTML queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions import physical, text
from tallyfold.operators import aggregate, html, latency, shape
from tallyfold.plans.registry import query, table


@query(r"""
    SELECT word, count(*) AS n
    FROM (SELECT unnest(regexp_split_to_array(text, '[ \t\n\r\f]+')) AS word FROM documents)
    WHERE word <> '' GROUP BY word
""")
def word_count(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.word_count(table(spark, folder, "documents"), "text")


@query("""
    SELECT count(*) AS matches FROM documents
    WHERE regexp_matches(text, 'tion', 'i') AND NOT regexp_matches(text, 'license', 'i')
""")
def match_count(spark: SparkSession, folder: str) -> DataFrame:
    return shape.match_count(table(spark, folder, "documents"), "text", "tion", "license")


@query("SELECT count(DISTINCT text) AS matches FROM conversations WHERE regexp_matches(text, 'the', 'i')")
def distinct_match_count(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.distinct_match_count(table(spark, folder, "conversations"), "text", "the")


def _counters() -> dict[str, Column]:
    return {"errors": F.col("event_type") == "error", "large": F.col("value") > 100}


_COUNTER_SQL = """
    SELECT 'events' AS "group", 'errors' AS name, 0::BIGINT AS initial,
           count(*) FILTER (WHERE event_type = 'error') AS value FROM events
    UNION ALL SELECT 'events', 'large', 1000, 1000 + count(*) FILTER (WHERE value > 100) FROM events
"""


@query(_COUNTER_SQL)
def named_counters(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.count_named(table(spark, folder, "events"), _counters(), "events", {"large": 1000})


@query(_COUNTER_SQL)
def observed_counters(spark: SparkSession, folder: str) -> DataFrame:
    initial = {"large": 1000}
    watched, seen = aggregate.observe_named(table(spark, folder, "events"), _counters(), "events")
    watched.write.format("noop").mode("overwrite").save()
    values = aggregate.counter_snapshot(seen, "events", initial)
    rows = [("events", name, initial.get(name, 0), value) for name, value in values.items()]
    return spark.createDataFrame(rows, "`group` string, name string, initial bigint, value bigint")


@query("""
    SELECT user_id AS host, floor(min(value) FILTER (WHERE event_type <> 'error'))::BIGINT AS min,
           floor(max(value) FILTER (WHERE event_type <> 'error'))::BIGINT AS max,
           floor(avg(value) FILTER (WHERE event_type <> 'error'))::BIGINT AS avg,
           (100 * count(*) FILTER (WHERE event_type = 'error')) // count(*) AS loss
    FROM events GROUP BY user_id
""")
def latency_summary(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return latency.latency_summary(events, "user_id", "value", F.col("event_type") != "error")


@query("""
    SELECT event_id, floor(value)::BIGINT AS min, floor(value)::BIGINT + 9 AS max, floor(value)::BIGINT + 4 AS avg,
           CASE WHEN event_type IN ('view', 'click') THEN (props->>'$.k')::BIGINT
                WHEN event_type = 'error' THEN 66 ELSE 33 END AS loss
    FROM events
""")
def parse_ping(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    low = F.floor("value")
    k = F.get_json_object("props", "$.k")

    def reply(n: int) -> Column:
        return F.format_string(f"64 bytes from host: icmp_seq={n} ttl=64 time=%s ms\n", F.col("value").cast("string"))

    linux = F.concat(
        reply(1),
        F.when(F.col("event_type") == "error", "").otherwise(reply(2)),
        F.lit("\n3 packets transmitted, some received\nrtt min/avg/max/mdev = "),
        F.format_string("%d.031/%d.5/%d.999/0.007 ms", low, low + 4, low + 9),
    )
    windows = F.concat(
        F.format_string("    Packets: Sent = 100, Received = 9, Lost = 1 (%s%% loss),\n", k),
        F.format_string("    Minimum = %dms, Maximum = %dms, Average = %dms\n", low, low + 9, low + 4),
    )
    report = F.when(F.col("event_type").isin("view", "click"), windows).otherwise(linux)
    parsed = latency.parse_ping(events.select("event_id", report.alias("report")), "report")
    return parsed.drop("report")


@query(r"""
    SELECT page_id, regexp_replace(url, '^.*/([^/]*)$', '\1') AS tail,
           translate(regexp_replace(regexp_replace(url, '^.*/([^/]*)$', '\1'), '\.[^.]*$', ''), '-', '_') AS table_name,
           lower(split_part(url, '.', -1)) AS suffix
    FROM pages
""")
def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    url = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id",
        text.path_tail(url).alias("tail"),
        text.table_name(url).alias("table_name"),
        text.path_suffix(url).alias("suffix"),
    )


@query("""
    SELECT p_partkey, 'tool-' || p_size || '.4.' || p_partkey || '-bin-x3.2.tgz' AS file,
           p_size || '.4.' || p_partkey AS versions
    FROM part
""")
def version_numbers(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    url = F.concat(F.lit("https://host/"), "p_brand", F.lit("/tool-"), "p_size", F.lit(".4."), "p_partkey",
                   F.lit("-bin-x3.2.tgz"))
    named = part.select("p_partkey", text.path_tail(url).alias("file"))
    return named.withColumn("versions", F.array_join(text.version_numbers(F.col("file")), " "))


@query(r"""
    SELECT doc_id, trim(translate(text, chr(13) || chr(10), ''), ' ' || chr(9)) AS stripped,
           translate(lang, 'en', '12') || '.txt' AS translated
    FROM documents
""")
def text_lines(spark: SparkSession, folder: str) -> DataFrame:
    padded = F.concat(F.lit("\t "), "text", F.lit(" \t\r\n"))
    return table(spark, folder, "documents").select(
        "doc_id",
        text.strip_line(padded).alias("stripped"),
        text.translate_with_suffix(F.col("lang"), "en", "12", ".txt").alias("translated"),
    )


@query("""
    SELECT event_id, floor(value)::BIGINT::VARCHAR AS whole, props->>'$.k' AS number,
           event_type AS role, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at
    FROM events
""")
def text_fields(spark: SparkSession, folder: str) -> DataFrame:
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))
    number = text.first_field(text.last_field(F.col("props"), ": "), "}")
    return table(spark, folder, "events").select(
        "event_id",
        text.integer_part(F.col("value").cast("string")).alias("whole"),
        number.alias("number"),
        text.role_of(F.concat(F.lit("Mode: "), "event_type", F.lit(" \t"))).alias("role"),
        text.iso_to_text(iso).alias("at"),
    )


@query("""
    SELECT c_custkey, c_name || ':9092,' || c_mktsegment || ':9092' AS servers,
           '10.0.0.' || c_nationkey AS ip, c_name AS host
    FROM customer
    UNION ALL
    SELECT c_custkey, c_name || ':9092,' || c_mktsegment || ':9092', '10.0.1.' || c_nationkey, c_mktsegment
    FROM customer
""")
def host_lists(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer").select(
        "c_custkey",
        F.concat_ws(",", "c_name", "c_mktsegment").alias("hosts"),
        F.concat(F.lit("10.0.0."), "c_nationkey", F.lit(":"), "c_name", F.lit(",10.0.1."), "c_nationkey", F.lit(":"),
                 "c_mktsegment").alias("pairs"),
    )
    return customer.select(
        "c_custkey", text.with_port(F.col("hosts"), 9092).alias("servers"), F.inline(text.address_pairs(F.col("pairs")))
    )


@query("""
    SELECT event_id, datediff('day', DATE '1970-01-01', ts::DATE)::INTEGER AS day, epoch_us(ts) // 1000 AS ts,
           upper(hex(event_type)) AS event_type, value
    FROM events
""")
def physical_values(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select(
        "event_id", F.col("ts").cast("date").alias("day"), "ts", "event_type", "value"
    )
    return physical.physical_values(events).withColumn("event_type", F.hex("event_type"))


@query("""
    WITH found AS (
        SELECT page_id, url AS page, regexp_extract_all(html, '<a [^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1) AS hrefs,
               regexp_extract_all(html, '<a [^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2) AS names FROM pages),
    links AS (SELECT page_id, page, unnest(range(len(hrefs)))::INTEGER AS pos, unnest(hrefs) AS href,
                     unnest(names) AS name FROM found)
    SELECT page_id, page AS base, pos, href, name, trim(page, '/') || '/' || name AS url
    FROM links WHERE NOT regexp_matches(name, 'parent', 'i')
""")
def links(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", F.col("url").alias("base"), "html")
    return html.extract_links(pages, "base", "html")


@query("""
    SELECT p_partkey, '/pub/' || p_brand || '/' AS base, u.name, p_size || 'K' AS size, p_type AS date,
           'pub/' || p_brand || '/' || u.name AS url
    FROM part, LATERAL (VALUES (p_name || '.rpm'), (p_brand || '.rpm')) AS u(name)
""")
def listing(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")

    def row(name: Column, size: Column, date: Column) -> Column:
        return F.format_string(
            '<tr><td class="link"><a href="%s" title="x">%s</a></td>'
            '<td class="size">%s</td><td class="date">%s</td></tr>',
            name,
            name,
            size,
            date,
        )

    size = F.concat("p_size", F.lit("K"))
    body = F.concat(
        F.lit("<table><tbody>"),
        row(F.lit("Parent directory/"), F.lit("-"), F.lit("-")),
        row(F.concat("p_name", F.lit(".rpm")), size, F.col("p_type")),
        row(F.concat("p_brand", F.lit(".rpm")), size, F.col("p_type")),
        F.lit("</tbody></table>"),
    )
    base = F.concat(F.lit("/pub/"), "p_brand", F.lit("/"))
    pages = part.select("p_partkey", base.alias("base"), body.alias("html"))
    return html.extract_listing(pages, "base", "html")
