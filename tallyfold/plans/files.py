"""File, table and stream queries. Their input files are written by Spark from the shared tables."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.operators import shape
from tallyfold.plans.match import PAIR_SQL
from tallyfold.plans.registry import query, table
from tallyfold.session import shared_folder
from tallyfold.sources import access_log, delimited, dump, properties, route, sql_script, stored, tables
from tallyfold.sources import retention as retained
from tallyfold.streaming import files, growing
from tallyfold.streaming import sequence as stream_sequence


@query("SELECT * FROM customer")
def load_psv(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer")
    path = shared_folder(spark, "customer") + ".psv"
    delimited.write_delimited(customer, path)
    return delimited.load_delimited(spark, path, customer.schema)


@query("SELECT doc_id, replace(text, chr(13), '') AS text, lang, source, n_chars FROM documents")
def load_csv_quoted(spark: SparkSession, folder: str) -> DataFrame:
    """Free text with commas, quotes and line breaks, as it is but for CRs, which stand at line ends too."""
    documents = table(spark, folder, "documents")
    path = shared_folder(spark, "documents") + ".csv"
    line_end = documents.withColumn("n_chars", F.concat("n_chars", F.lit("\r")))
    delimited.write_delimited(line_end, path, quoted_breaks=True)
    return delimited.load_delimited(spark, path, documents.schema, quoted_breaks=True)


_RESCUE_SQL = """
    SELECT o_orderkey,
        CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'NULL' WHEN 2 THEN o_orderstatus || ',"' || o_orderpriority || '"'
            WHEN 3 THEN '' ELSE o_orderpriority END AS o_orderpriority,
        CASE WHEN o_orderkey % 7 NOT IN (4, 5) THEN o_totalprice END AS o_totalprice,
        CASE o_orderkey % 7
            WHEN 4 THEN o_orderkey || ',' || o_orderpriority
            WHEN 5 THEN o_orderkey || ',' || o_orderpriority || ',dear'
            WHEN 6 THEN o_orderkey || ',' || o_orderpriority || ',' || o_totalprice || ',,more' END AS line,
        CASE o_orderkey % 7 WHEN 4 THEN 2 WHEN 5 THEN 3 WHEN 6 THEN 5 END AS fields,
        CASE o_orderkey % 7 WHEN 4 THEN '' WHEN 5 THEN 'o_totalprice' WHEN 6 THEN '' END AS uncast
    FROM orders
"""


@query(_RESCUE_SQL)
def load_rescued(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as text: bare and quoted NULL, quoted separators and quotes, empty, short, long and uncastable rows."""
    kind = F.col("o_orderkey") % 7
    plain = F.concat_ws(",", "o_orderkey", "o_orderpriority")
    quoted = F.concat("o_orderstatus", F.lit(',""'), "o_orderpriority", F.lit('""'))
    middle = F.when(kind == 0, "NULL").when(kind == 1, '"NULL"').when(kind == 2, F.concat(F.lit('"'), quoted, F.lit('"')))
    middle = middle.when(kind == 3, "").otherwise(F.col("o_orderpriority"))
    whole = F.concat_ws(",", "o_orderkey", middle, "o_totalprice")
    line = F.when(kind == 4, plain).when(kind == 5, F.concat(plain, F.lit(",dear"))).when(kind == 6, F.concat(whole, F.lit(",,more")))
    path = shared_folder(spark, "orders")
    orders = table(spark, folder, "orders")
    orders.select(F.concat(line.otherwise(whole), F.lit("\r"))).write.text(path)
    rows = delimited.load_rescued(spark, path, orders.select("o_orderkey", "o_orderpriority", "o_totalprice").schema, ",")
    said = [F.col("rescued.line"), F.col("rescued.fields"), F.concat_ws(",", F.col("rescued.uncast")).alias("uncast")]
    return rows.select("o_orderkey", "o_orderpriority", "o_totalprice", *said[:2], F.when(F.col("rescued").isNotNull(), said[2]).alias("uncast"))


@query("""
    SELECT 'nation' AS source, n_nationkey AS id, n_name AS name FROM nation
    UNION ALL SELECT 'supplier_list', s_suppkey, s_name FROM supplier
""")
def load_folder(spark: SparkSession, folder: str) -> DataFrame:
    base = shared_folder(spark, "folder")
    nation = table(spark, folder, "nation").selectExpr("cast(n_nationkey as bigint) AS id", "n_name AS name")
    supplier = table(spark, folder, "supplier").selectExpr("s_suppkey AS id", "s_name AS name")
    delimited.write_delimited(nation, f"{base}/nation.tsv")
    delimited.write_delimited(supplier, f"{base}/deep/supplier-list.ssv")
    loaded = delimited.load_folder(spark, base, {"nation": nation.schema, "supplier_list": supplier.schema})
    parts = [df.select(F.lit(name).alias("source"), "id", "name") for name, df in sorted(loaded.items())]
    return parts[0].unionByName(parts[1])


@query("SELECT unnest(string_split(text, chr(10))) AS value FROM documents")
def gzip_text(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "text")
    table(spark, folder, "documents").select("text").write.option("compression", "gzip").text(path)
    return delimited.read_text(spark, path)


@query(r"""
    SELECT 'customer' AS "table", 1 AS section, 'DROP TABLE IF EXISTS customer; CREATE TABLE customer ('
        || 'c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string);' AS line
    UNION ALL
    SELECT 'customer', 2, 'INSERT IGNORE INTO customer VALUES (' || c_custkey || ',''' || c_name || ''',' || c_nationkey
        || ',' || c_acctbal || ',''' || c_mktsegment || ''');' FROM customer
    UNION ALL
    SELECT 'documents', 1, 'DROP TABLE IF EXISTS documents; CREATE TABLE documents ('
        || 'doc_id bigint, text string, lang string, source string, n_chars bigint);'
    UNION ALL
    SELECT 'documents', 2, 'INSERT IGNORE INTO documents VALUES (' || doc_id || ','''
        || replace(replace(replace(replace(text, '\', '\\'), '''', '\'''), chr(10), '\n'), chr(13), '\r')
        || ''',''' || lang || ''',''' || source || ''',' || n_chars || ');'
    FROM documents
""")
def dump_sql(spark: SparkSession, folder: str) -> DataFrame:
    out = shared_folder(spark, "dump")
    dumped = {
        "customer": table(spark, folder, "customer"),
        "documents": table(spark, folder, "documents"),
    }
    dump.dump_tables(dumped, out)
    lines = spark.read.schema("value string, table string, section int").option("lineSep", "\n").text(out)
    return lines.select("table", "section", F.col("value").alias("line"))


_DUMPED = ("customer", "documents", "embeddings", "events", "labels", "nation", "orders", "part")
_DUMPED_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS name, count(*) AS n, sum({key})::BIGINT AS keys FROM {t}"
    for t, key in zip(_DUMPED, ("c_custkey", "doc_id", "vec_id", "event_id", "doc_id", "n_nationkey", "o_orderkey", "p_partkey"), strict=True)
)


@query(_DUMPED_SQL)
def dump_database(spark: SparkSession, folder: str) -> DataFrame:
    """A database with all columns of its tables, dumped in the dialect that others load; read back are a row's table and key."""
    base = shared_folder(spark, "database")
    name = base.rsplit("/", 1)[-1].replace("-", "_")
    spark.sql(f"CREATE DATABASE {name} LOCATION '{base}'")
    for t in _DUMPED:
        table(spark, folder, t).write.saveAsTable(f"{name}.{t}")
    out = shared_folder(spark, "dump")
    dump.dump_database(spark, name, out)
    lines = spark.read.schema("value string, table string, section int").option("lineSep", "\n").text(out).where("section = 2")
    row = F.regexp_extract("value", r'^INSERT INTO "(\w+)" VALUES \((-?\d+),.*\);$', 2).cast("long")
    return lines.groupBy(F.col("table").alias("name")).agg(F.count("*").alias("n"), F.sum(row).alias("keys"))


@query("SELECT * FROM supplier")
def dump_parquet(spark: SparkSession, folder: str) -> DataFrame:
    out = shared_folder(spark, "dump")
    dump.dump_tables({"supplier": table(spark, folder, "supplier")}, out, fmt="parquet")
    return spark.read.parquet(f"{out}/supplier")


@query("""
    SELECT 'c.' || c_custkey || '.segment' AS key, c_mktsegment AS value FROM customer
    UNION ALL SELECT 'c.' || c_custkey || '.balance', c_acctbal::VARCHAR FROM customer
    UNION ALL SELECT 'c.' || c_custkey || '.nation', c_nationkey::VARCHAR FROM customer
""")
def read_properties(spark: SparkSession, folder: str) -> DataFrame:
    """Comments, blanks, CRs, an equals sign inside a value, and a key defined twice."""
    key = F.concat(F.lit("c."), "c_custkey")
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("# about "), key),
        F.concat(key, F.lit(".segment = old")),
        F.concat(F.lit("  "), key, F.lit(".nation = id="), "c_nationkey", F.lit("\r")),
        F.lit(" \t "),
        F.concat(F.lit("\t"), key, F.lit(".balance="), "c_acctbal", F.lit(" \t# in cents")),
        F.concat(key, F.lit(".segment = "), "c_mktsegment", F.lit("   # again")),
    )
    path = shared_folder(spark, "properties")
    table(spark, folder, "customer").select(lines).write.text(path)
    return properties.read_properties(spark, path).select("key", "value")


@query("""
    SELECT 'c.' || c_custkey || '.name' AS name, c_name AS value FROM customer
    UNION ALL SELECT 'c.' || c_custkey || '.balance', c_acctbal::VARCHAR FROM customer
""")
def xml_properties(spark: SparkSession, folder: str) -> DataFrame:
    def entry(name: str, value: str) -> Column:
        key = F.concat(F.lit("c."), "c_custkey", F.lit(f".{name}"))
        return F.struct(key.alias("name"), F.col(value).cast("string").alias("value"))

    entries = F.inline(F.array(entry("name", "c_name"), entry("balance", "c_acctbal")))
    path = shared_folder(spark, "xml")
    written = table(spark, folder, "customer").select(entries).write.format("xml")
    written.option("rootTag", "configuration").option("rowTag", "property").save(path)
    return properties.read_xml_properties(spark, path)


def _status() -> Column:
    """An answer code for each event, made from its kind."""
    codes = {"error": 500, "signup": 404, "click": 304, "purchase": 499}
    kind = F.col("event_type")
    out = F.lit(200)
    for name, code in codes.items():
        out = F.when(kind == name, code).otherwise(out)
    return out


_STATUS_SQL = """CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 WHEN 'click' THEN 304
                 WHEN 'purchase' THEN 499 ELSE 200 END"""
_TIME = "yyyy-MM-dd HH:mm:ss"

_MAIN_SQL = f"""
    SELECT date_trunc('second', ts) AS time, '10.0.0.' || user_id AS client, {_STATUS_SQL} AS status,
           'host' AS host, event_id AS bytes, value AS request_time, 'GET /' || event_type || ' HTTP/1.1' AS request,
           'GET' AS method, '/' || event_type AS uri, 'HTTP/1.1' AS protocol, 'agent -|- ' || props AS agent
    FROM events
"""


def _main_log(spark: SparkSession, folder: str) -> DataFrame:
    line = F.concat_ws(
        "-|-",
        F.date_format("ts", _TIME),
        F.concat(F.lit("10.0.0."), "user_id"),
        _status(),
        F.lit("host"),
        F.col("event_id"),
        F.col("value"),
        F.concat(F.lit("GET /"), "event_type", F.lit(" HTTP/1.1")),
        F.concat(F.lit("agent -|- "), "props"),
    )
    path = shared_folder(spark, "access")
    table(spark, folder, "events").select(line).write.text(path)
    return delimited.read_text(spark, path)


@query(_MAIN_SQL)
def access_main(spark: SparkSession, folder: str) -> DataFrame:
    return access_log.parse_access_main(_main_log(spark, folder), "value")


@query(f"SELECT * FROM ({_MAIN_SQL}) WHERE status IN (400, 404, 499) OR status BETWEEN 500 AND 505")
def failed_requests(spark: SparkSession, folder: str) -> DataFrame:
    return shape.failed_requests(access_log.parse_access_main(_main_log(spark, folder), "value"))


@query(f"""
    SELECT date_trunc('second', ts) AS time, 'host' AS host, '10.0.0.' || user_id AS client, {_STATUS_SQL} AS status,
           event_id AS bytes, value AS request_time, 'example.org' AS domain, '/' || event_type AS url,
           props AS referer, 'agent' AS agent, '-' AS x_forwarded_for, NULL::VARCHAR AS corrupt
    FROM events
    UNION ALL
    SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, event_type FROM events
""")
def access_json(spark: SparkSession, folder: str) -> DataFrame:
    """One good line and one that is no JSON for every event."""
    fields = [
        F.date_format("ts", _TIME).alias("timestamp"),
        F.lit("host").alias("host"),
        F.concat(F.lit("10.0.0."), "user_id").alias("client"),
        _status().cast("string").alias("status"),
        F.col("event_id").cast("string").alias("size"),
        F.col("value").cast("string").alias("response-time"),
        F.lit("example.org").alias("domain"),
        F.concat(F.lit("/"), "event_type").alias("url"),
        F.col("props").alias("referer"),
        F.lit("agent").alias("agent"),
        F.lit("-").alias("x_forwarded_for"),
    ]
    lines = F.concat_ws("\n", F.to_json(F.struct(*fields)), "event_type")
    path = shared_folder(spark, "access")
    table(spark, folder, "events").select(lines).write.text(path)
    return access_log.parse_access_json(delimited.read_text(spark, path), "value")


@query("""
    SELECT n_nationkey, n_name, n_regionkey FROM nation
    UNION ALL VALUES (101, 'ATLANTIS', NULL), (102, 'LEMURIA', NULL)
""")
def append_rows(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation")
    return tables.append_rows(nation, [(101, "ATLANTIS"), (102, "LEMURIA")], ["n_nationkey", "n_name"])


@query("""
    WITH dated AS (SELECT * REPLACE (CASE WHEN event_id % 97 <> 0 THEN ts END AS ts) FROM events)
    SELECT *, ts::DATE AS day FROM dated WHERE ts IS NULL OR ts >= (SELECT max(ts) - INTERVAL 168 HOUR FROM dated)
""")
def retention(spark: SparkSession, folder: str) -> DataFrame:
    """Events that come in two steps, some without a time: the second step drops days and cuts the one at the bound."""
    events = table(spark, folder, "events").withColumn("ts", F.when(F.col("event_id") % 97 != 0, F.col("ts")))
    later = F.col("ts") >= events.agg(F.max("ts") - F.expr("INTERVAL 60 HOURS")).scalar()
    path = shared_folder(spark, "events")
    retained.append_retained(events.where(~later | F.col("ts").isNull()), path, "ts")
    retained.append_retained(events.where(later), path, "ts")
    return spark.read.parquet(path)


def _customer_table(spark: SparkSession, folder: str) -> str:
    schema = T.StructType(
        [
            T.StructField("c_custkey", T.LongType(), metadata={"comment": "customer number"}),
            T.StructField("c_name", T.VarcharType(64), metadata={"comment": "name"}),
            T.StructField("c_nationkey", T.IntegerType(), metadata={"comment": "nation"}),
            T.StructField("c_acctbal", T.DoubleType(), metadata={"comment": "balance"}),
            T.StructField("c_mktsegment", T.VarcharType(32), metadata={"comment": "the customer's segment"}),
        ]
    )
    location = shared_folder(spark, "customers")
    name = location.rsplit("/", 1)[-1].replace("-", "_")
    tables.create_table(spark, name, schema, "who buys", location)
    table(spark, folder, "customer").select(*schema.names).write.insertInto(name)
    return name


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def create_table(spark: SparkSession, folder: str) -> DataFrame:
    return spark.table(_customer_table(spark, folder))


@query("""
    SELECT c_custkey, c_name, c_nationkey, c_acctbal,
        CASE WHEN c_mktsegment = 'MACHINERY' AND c_acctbal > 0 THEN 'MACHINES' ELSE c_mktsegment END AS c_mktsegment
    FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 497000)
    UNION ALL SELECT -1, 'nobody', NULL, 0, 'MACHINES'
""")
def rewrite_table(spark: SparkSession, folder: str) -> DataFrame:
    """A stored table changed in place by file: rows upserted under a new segment or a new key, others deleted by key and by condition."""
    name = _customer_table(spark, folder)
    rows = table(spark, folder, "customer").select(*spark.table(name).columns)
    renamed = rows.where("c_mktsegment = 'MACHINERY' AND c_acctbal > 0").withColumn("c_mktsegment", F.lit("MACHINES"))
    nobody = rows.sparkSession.createDataFrame([(-1, "nobody", None, 0.0, "MACHINES")], rows.schema)
    stored.upsert_stored(spark, name, renamed.unionByName(nobody).withColumn("v", F.lit(1)), "c_custkey", "v")
    stored.delete_stored_where(spark, name, F.col("c_mktsegment") == "BUILDING")
    dear = table(spark, folder, "orders").where("o_totalprice > 497000").select(F.col("o_custkey").alias("c_custkey"))
    stored.delete_stored_keys(spark, name, dear, "c_custkey")
    return spark.table(name)


@query("""
    SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders
    WHERE o_orderstatus = 'F' GROUP BY o_orderpriority
""")
def run_sql(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "orders").createOrReplaceTempView("script_orders")
    return sql_script.run_sql(
        spark,
        """
        -- finished orders; the mark between statements may stand in quotes
        CREATE OR REPLACE TEMPORARY VIEW finished AS
            SELECT *, ';' AS mark FROM script_orders WHERE o_orderstatus = 'F';
        /* the report */
        SELECT o_orderpriority, count(mark) AS n, max(o_totalprice) AS top FROM finished GROUP BY o_orderpriority;
        """,
    )


@query("""
    SELECT n_name, count(*) AS n, sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS in_credit
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
""")
def run_folder(spark: SparkSession, folder: str) -> DataFrame:
    """A folder with scripts, one of them with a block, and the data they are about, by one entry; appended, then asked about."""
    base = shared_folder(spark, "work")
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    suffix = base.rsplit("-", 1)[-1]
    names = {t: f"{t}_{suffix}" for t in ("customer", "nation")}
    script = f"""
        -- tables for what lies beside this file; the mark ';' may stand in quotes
        BEGIN
            IF 1 < 2 THEN
                CREATE TABLE {names["customer"]} (c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE) USING parquet
                    COMMENT 'who buys; BEGIN' LOCATION '{base}-customer';
            END IF;
            CREATE TABLE {names["nation"]} (n_nationkey INT, n_name STRING) USING parquet LOCATION '{base}-nation';
            SELECT CASE WHEN true THEN 1 END;
        END;
        CREATE OR REPLACE TEMPORARY VIEW report_{suffix} AS
            SELECT n_name, count(*) AS n, sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS in_credit
            FROM {names["customer"]} JOIN {names["nation"]} ON c_nationkey = n_nationkey GROUP BY n_name;
    """
    spark.createDataFrame([(script,)], "value string").coalesce(1).write.text(f"{base}/a-first.sql")
    delimited.write_delimited(customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), f"{base}/deep/{names['customer']}.psv")
    nation.select("n_nationkey", "n_name").write.option("header", "false").csv(f"{base}/{names['nation']}")
    route.execute_into_tables(spark, base)
    return route.execute(spark, f"SELECT * FROM report_{suffix}; -- the report")[0]


_LINE = ("event_id", "user_id", "event_type")
_LINE_SQL = "event_id || '|' || user_id || '|' || event_type"


def _event_lines(spark: SparkSession, folder: str) -> str:
    path = shared_folder(spark, "lines")
    table(spark, folder, "events").select(F.concat_ws("|", *_LINE)).write.text(path)
    return path


@query(f"SELECT {_LINE_SQL} AS value FROM events")
def tail(spark: SparkSession, folder: str) -> DataFrame:
    out = shared_folder(spark, "tail")
    files.drain(files.tail_text(spark, _event_lines(spark, folder), 100), out, shared_folder(spark, "position"))
    return spark.read.parquet(out)


def _grow(lines: DataFrame, folder: str, lengths: dict[str, int], parts: int, whole: bool) -> dict[str, int]:
    """Add ``line`` to the log of each ``part``, in order of ``event_id``: what a service does to its own log.

    Unless ``whole``, the last line of a log stays without its break. A log is first cut to the length it had, so a task that is
    run again writes the same bytes.
    """

    def write(rows: Iterator[Row]) -> None:
        for part, group in itertools.groupby(rows, lambda r: r.part):
            name = f"part-{part}.log"
            with open(f"{path}/{name}", "ab") as log:
                log.truncate(lengths.get(name, 0))
                between = b"\n" if lengths.get(name) else b""
                for row in group:
                    log.write(between + row.line.encode())
                    between = b"\n"
                if whole:
                    log.write(b"\n")

    path = growing.open_system(folder)[1]
    Path(path).mkdir(parents=True, exist_ok=True)
    lines.repartition(parts, "part").sortWithinPartitions("part", "event_id").foreachPartition(write)
    return {name.rsplit("/", 1)[-1]: size for name, size in growing.grown_files(folder).items()}


@query(f"SELECT {_LINE_SQL} AS value FROM events")
def tail_growing(spark: SparkSession, folder: str) -> DataFrame:
    """Logs that grow between two runs; the first run finds the last line of each half-written."""
    events = table(spark, folder, "events")
    lines = events.select(F.pmod("event_id", F.lit(4)).alias("part"), "event_id", F.concat_ws("|", *_LINE).alias("line"))
    source, out, position = (shared_folder(spark, n) for n in ("logs", "tail", "position"))
    half = F.col("event_id") < lines.agg(F.avg("event_id")).scalar()
    lengths: dict[str, int] = {}
    for rows, whole in ((lines.where(half), False), (lines.where(~half), True)):
        lengths = _grow(rows, source, lengths, 4, whole)
        files.drain(growing.tail_growing(spark, source, "*.log"), out, position)
    return spark.read.parquet(out).select("value")


@query("SELECT count(*) AS matches FROM events WHERE event_type = 'error' OR event_type = 'view'")
def stream_match_count(spark: SparkSession, folder: str) -> DataFrame:
    out = shared_folder(spark, "totals")
    lines = files.tail_text(spark, _event_lines(spark, folder), 100)
    running = files.stream_match_count(lines, "value", "ERROR|view", "signup")
    files.drain_totals(running, out, shared_folder(spark, "position"))
    return spark.read.parquet(out)


@query("SELECT event_id, user_id, event_type FROM events")
def stream_load(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").select(*_LINE).schema
    out = shared_folder(spark, "loaded")
    files.stream_load(spark, _event_lines(spark, folder), schema, "|", out, shared_folder(spark, "position"))
    return spark.read.parquet(out)


@query(PAIR_SQL)
def sequence_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events from files, drained; a closing beat after the last event moves the watermark past all of them."""
    events = table(spark, folder, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), "event_id", "user_id", "event_type"
    )
    beat = events.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).select(
        "ts", F.lit(-1).alias("event_id"), F.lit(-1).alias("user_id"), F.lit("beat").alias("event_type")
    )
    source = shared_folder(spark, "events")
    events.unionByName(beat).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    found = stream_sequence.match_sequence_stream(
        stream, "user_id", "ts", "event_id", "event_type", ["error", "error"], "1 hour"
    )
    out = shared_folder(spark, "matches")
    with stream_sequence.state_settings(spark):
        files.drain(found, out, shared_folder(spark, "state"))
    return spark.read.parquet(out).withColumns(
        {n: F.col(n).cast("timestamp_ntz") for n in ("start_ts", "end_ts")}
    )
