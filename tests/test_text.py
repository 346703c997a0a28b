from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tallyfold.functions import physical, text
from tallyfold.operators import aggregate, html, latency, shape


def one(spark, column, **values):
    literal = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return literal.select(column).first()[0]


def test_urls(spark):
    spark_url = "https://host/dist/spark-3.2.4-bin-hadoop3.2.tgz"
    assert one(spark, text.path_tail(F.col("u")), u=spark_url) == "spark-3.2.4-bin-hadoop3.2.tgz"
    assert one(spark, text.path_tail(F.col("u")), u="plain") == "plain"
    assert one(spark, text.version_numbers(text.path_tail(F.col("u"))), u=spark_url) == ["3.2.4"]
    assert one(spark, text.version_numbers(F.col("u")), u="jdk-8u421-linux-x64.tar.gz") == []
    assert one(spark, text.table_name(F.col("u")), u="/data/order-items.v2.csv") == "order_items.v2"
    assert one(spark, text.path_suffix(F.col("u")), u="/data/a.PSV") == "psv"


def test_lines(spark):
    assert one(spark, text.strip_line(F.col("s")), s=" \ta b\r\n\t ") == "a b"
    assert one(spark, text.integer_part(F.col("s")), s="12.75") == "12"
    assert one(spark, text.first_field(F.col("s"), "="), s="a=b=c") == "a"
    assert one(spark, text.last_field(F.col("s"), "="), s="a=b=c") == "c"
    assert one(spark, text.role_of(F.col("s")), s="Mode: leader ") == "leader"
    assert one(spark, text.translate_with_suffix(F.col("s"), ",;", " ", "!"), s="a,b;c") == "a b c!"


def test_lists(spark):
    assert one(spark, text.with_port(F.col("s"), 9092), s="a,b,c") == "a:9092,b:9092,c:9092"
    assert one(spark, text.with_port(F.col("s"), 2181, "/kafka"), s="a,b") == "a:2181/kafka,b:2181/kafka"
    pairs = one(spark, text.address_pairs(F.col("s")), s="192.168.200.220:master,192.168.200.221:slaver1")
    assert [tuple(p) for p in pairs] == [("192.168.200.220", "master"), ("192.168.200.221", "slaver1")]


def test_iso_time(spark):
    assert one(spark, text.iso_to_text(F.col("s")), s="2024-02-03T04:05:06+08:00") == "2024-02-03 04:05:06"
    assert one(spark, text.iso_to_timestamp(F.col("s")), s="no time") is None
    assert one(spark, text.iso_to_timestamp(F.col("s")), s="2024-13-03T04:05:06") is None


def test_physical_values(spark):
    moment = datetime.datetime(1969, 12, 31, 23, 59, 59, 999_500)
    df = spark.createDataFrame(
        [(datetime.date(1970, 1, 3), moment, moment, "é", bytearray(b"\x00"), 7)],
        "d date, t timestamp, n timestamp_ntz, s string, b binary, i int",
    )
    row = physical.physical_values(df).first()
    assert (row.d, row.n, bytes(row.s), bytes(row.b), row.i) == (2, -1, "é".encode(), b"\x00", 7)
    assert row.t == df.select(F.unix_millis("t")).first()[0]


def test_zone_free_micros_ignore_the_session_zone(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-03-31 02:30:00.000001' AS n")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        found = df.select(physical.epoch_micros(F.col("n"), df.schema["n"].dataType)).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    wanted = datetime.datetime(2024, 3, 31, 2, 30, tzinfo=datetime.timezone.utc).timestamp() * 1_000_000 + 1
    assert found == int(wanted)


def test_word_count(spark, rows):
    df = spark.createDataFrame([("master slaver1\nslaver2",), (" master\t",), (None,), ("",)], "line string")
    assert rows(aggregate.word_count(df, "line")) == [("master", 2), ("slaver1", 1), ("slaver2", 1)]


def test_matches(spark):
    lines = ["ERROR: a", "error: already exists", "fine", "ERROR: a", None]
    df = spark.createDataFrame([(line,) for line in lines], "l string")
    assert shape.match_count(df, "l", "error:", "already exists").first()[0] == 2
    assert aggregate.distinct_match_count(df, "l", "error").first()[0] == 2


def test_observed_counters(spark):
    watched, seen = aggregate.observe_named(spark.range(10), {"even": F.col("id") % 2 == 0}, "ids")
    watched.write.format("noop").mode("overwrite").save()
    assert aggregate.counter_snapshot(seen, "ids", {"even": 100}) == {"even": 105}


def test_failed_requests(spark):
    df = spark.createDataFrame([(s,) for s in (200, 400, 404, 499, 500, 503, 505, 506, None)], "status int")
    assert sorted(r[0] for r in shape.failed_requests(df).collect()) == [400, 404, 499, 500, 503, 505]


LINUX = """PING master (192.168.200.220) 56(84) bytes of data.
64 bytes from master: icmp_seq=1 ttl=64 time=0.5 ms
64 bytes from master: icmp_seq=3 ttl=64 time=30.5 ms

--- master ping statistics ---
3 packets transmitted, 2 received, 33% packet loss, time 198ms
rtt min/avg/max/mdev = 0.500/15.500/30.500/0.031 ms
"""
WINDOWS = """    Packets: Sent = 4, Received = 3, Lost = 1 (25% loss),
Approximate round trip times in milli-seconds:
    Minimum = 3ms, Maximum = 9ms, Average = 5ms
"""
WINDOWS_OTHER = "    数据包: 已发送 = 4，已接收 = 4，丢失 = 0 (0% 丢失)，\n    最短 = 3ms，最长 = 9ms，平均 = 5ms\n"


def test_ping_reports(spark):
    reports = {"l": LINUX, "w": WINDOWS, "z": WINDOWS_OTHER, "x": "unknown host"}
    df = spark.createDataFrame(list(reports.items()), "h string, r string")
    found = {r.h: (r.min, r.max, r.avg, r.loss) for r in latency.parse_ping(df, "r").collect()}
    assert found == {"l": (0, 30, 15, 33), "w": (3, 9, 5, 25), "z": (3, 9, 5, 0), "x": (None, None, None, None)}
    sent = latency.parse_ping(df.where("h = 'l'"), "r", sent=100).first()
    assert sent.loss == 98


def test_latency_summary(spark, rows):
    probes = [("a", 1.9, True), ("a", 4.2, True), ("a", None, False), ("b", None, False)]
    df = spark.createDataFrame(probes, "h string, v double, ok boolean")
    found = latency.latency_summary(df, "h", "v", F.col("ok"))
    assert rows(found) == [("a", 1, 4, 3, 33), ("b", None, None, None, 100)]


def test_mean_latency_is_that_of_the_values_as_written(spark, rows):
    # as doubles 2.98 + 0.01 + 0.01 is less than three
    values = {"a": [2.98, 0.01, 0.01], "c": [-1.5, -1.0], "d": [1e300], "e": [2.999999999999], "f": [1e14 + 0.5, 1e14], "g": [4.0, float("inf")]}
    df = spark.createDataFrame([(h, v) for h, own in values.items() for v in own], "h string, v double")
    found = latency.latency_summary(df.coalesce(1), "h", "v", F.lit(True))
    most = 2**63 - 1
    assert [(r[0], r[3]) for r in rows(found)] == [("a", 1), ("c", -2), ("d", most), ("e", 2), ("f", 10**14), ("g", most)]


LISTING = """<table><tbody>
<tr><td class="link"><a href="../">Parent directory/</a></td><td class="size">-</td><td class="date">-</td></tr>
<tr><td class="link"><a href="a.rpm" title="a">a.rpm</a></td><td class="size">1 K</td><td class="date">2024-01-01</td></tr>
<tr><td class="link"><a href="b.rpm" title="b">b<b>.rpm</b></a></td><td class="size">2 K</td><td class="date">2024-01-02</td></tr>
</tbody></table><p><a href="/other">elsewhere</a></p>"""


def test_html(spark, rows):
    pages = spark.createDataFrame([("https://host/pub/", LISTING)], "base string, html string")
    assert rows(html.extract_listing(pages, "base", "html"), "name", "size", "date", "url") == [
        ("a.rpm", "1 K", "2024-01-01", "https://host/pub/a.rpm"),
        ("b.rpm", "2 K", "2024-01-02", "https://host/pub/b.rpm"),
    ]
    everything = html.extract_links(pages, "base", "html")
    found = [(1, "a.rpm", "a.rpm"), (2, "b.rpm", "b.rpm"), (3, "/other", "elsewhere")]
    assert rows(everything, "pos", "href", "name") == found
    assert html.extract_links(pages, "base", "html", listing=True).count() == 2
