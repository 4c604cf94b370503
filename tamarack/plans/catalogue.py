"""Every query of the engine by name, with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions import geo, pii, places, records, scores, text, web
from tamarack.operators import leads, lifecycle, pages, relational, reports, resolution, retention
from tamarack.scratch import Scratch
from tamarack.session import ship, table

FLAGSHIP = "queue_composite"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT user_id, event_id, ts, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest event of each user."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return relational.newest(events, "user_id", ["ts", "event_id"])


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS rank FROM events QUALIFY rank <= 3")
def top_n_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three newest events of each user."""
    return relational.newest_n(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 3).select("user_id", "event_id", "rank")


@query("""
WITH r AS (SELECT user_id, event_type, row_number() OVER w AS n, first_value(event_type) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)),
b AS (SELECT user_id, min(n) AS n FROM r WHERE event_type <> f GROUP BY user_id)
SELECT r.user_id, any_value(f) AS event_type, count(*) AS streak FROM r LEFT JOIN b USING (user_id) WHERE r.n < coalesce(b.n, 1000000000) GROUP BY r.user_id
""")
def status_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the newest events in a row have the newest type."""
    return relational.streak(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS failed, count(*) FILTER (o_orderstatus = 'P') AS cancelled, count(*) AS total,
CASE WHEN count(*) FILTER (o_orderstatus IN ('F', 'O')) > 0 THEN round(count(*) FILTER (o_orderstatus = 'F') / count(*) FILTER (o_orderstatus IN ('F', 'O')), 4) END AS success_rate FROM orders GROUP BY 1
""")
def rate_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by outcome and a rate that leaves cancelled out."""
    status = F.col("o_orderstatus")
    counted = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(status == "F").alias("done"), F.count_if(status == "O").alias("failed"), F.count_if(status == "P").alias("cancelled"), F.count("*").alias("total"))
    return counted.withColumn("success_rate", scores.rate(F.col("done"), F.col("done") + F.col("failed")))


@query("""
SELECT l_returnflag, count(*) AS n, round(quantile_cont(d, 0.5), 3) AS p50, round(quantile_cont(d, 0.95), 3) AS p95
FROM (SELECT l_returnflag, date_diff('day', o_orderdate, l_shipdate)::DOUBLE AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1
""")
def timings_pctl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: exact, interpolated percentiles of the shipping delay."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    days = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_returnflag", F.datediff("l_shipdate", "o_orderdate").cast("double").alias("d"))
    return reports.percentiles(days, "l_returnflag", "d", p50=0.5, p95=0.95)


@query("SELECT n_name, count(*) AS calls, count(*) FILTER (c_acctbal < 0) AS errors, round(count(*) FILTER (c_acctbal < 0) / count(*), 4) AS error_rate FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")
def error_rate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of accounts below zero per nation; nations without customers are absent."""
    counted = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("calls"), F.count_if(F.col("c_acctbal") < 0).alias("errors"))
    return counted.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "calls", "errors", scores.rate(F.col("errors"), F.col("calls")).alias("error_rate"))


@query("SELECT n_name, count(s_suppkey) AS records, max(s_acctbal) AS latest FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON n_nationkey = s_nationkey GROUP BY 1")
def freshness_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and latest per source, sources without records kept."""
    found = table(spark, sf_dir, "supplier").where("s_acctbal > 0").groupBy("s_nationkey").agg(F.count("*").alias("records"), F.max("s_acctbal").alias("latest"))
    return table(spark, sf_dir, "nation").join(found, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_name", F.coalesce("records", F.lit(0)).alias("records"), "latest")


@query("SELECT event_type, count(event_id) AS n FROM (SELECT unnest(['view', 'click', 'purchase', 'refund', 'never']) AS event_type) LEFT JOIN events USING (event_type) GROUP BY 1")
def zero_filled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over a fixed list of values."""
    return relational.zero_filled(table(spark, sf_dir, "events"), "event_type", ["view", "click", "purchase", "refund", "never"])


@query(r"""
SELECT code, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS code FROM documents) GROUP BY 1
""")
def distinct_codes_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per word. Words are made distinct within each document first, which keeps the shuffle small."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("code"))
    return words.groupBy("code").agg(F.countDistinct("doc_id").alias("n"))


@query("""
SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus = 'F') AS top, count(*) FILTER (o_totalprice < 50000) AS weak FROM orders GROUP BY 1 HAVING bool_or(o_orderpriority = '1-URGENT')
""")
def having_bool_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered aggregates; the condition picks customers, the aggregates span all their orders."""
    grouped = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("top"), F.count_if(F.col("o_totalprice") < 50000).alias("weak"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("has"))
    return grouped.where("has").drop("has")


_BLOCK = "(SELECT s_suppkey AS id, CASE WHEN s_acctbal < 2000 THEN s_nationkey END AS nation FROM supplier WHERE s_acctbal < 5000)"


@query(f"SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM {_BLOCK} s WHERE s.id = c_custkey OR s.nation = c_nationkey)")
def disjunctive_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that no suppression matches by id or nation; nulls match nothing."""
    block = table(spark, sf_dir, "supplier").where("s_acctbal < 5000").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") < 2000, F.col("s_nationkey")).alias("nation"))
    return relational.any_key_anti(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), block, [("c_custkey", "id"), ("c_nationkey", "nation")]).select("c_custkey")


@query(f"SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM {_BLOCK} s WHERE s.id = c_custkey OR s.nation = c_nationkey)")
def disjunctive_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers that a suppression matches."""
    block = table(spark, sf_dir, "supplier").where("s_acctbal < 5000").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") < 2000, F.col("s_nationkey")).alias("nation"))
    return relational.any_key_semi(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), block, [("c_custkey", "id"), ("c_nationkey", "nation")], "c_custkey").select("c_custkey")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5, A21."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("""
SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) < (SELECT (o_orderdate, o_orderkey) FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) // 2 FROM orders))
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51
""")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page after a cursor, with one row more than the page holds."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    middle = orders.agg(F.floor(F.max("o_orderkey") / 2).alias("k")).join(orders, F.col("k") == F.col("o_orderkey")).select("o_orderdate", "o_orderkey")
    return relational.keyset_page_at(orders, ["o_orderdate", "o_orderkey"], 50, middle)


@query("""
SELECT o_orderkey, price FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders)
WHERE price < 30000.0 OR (price = 30000.0 AND o_orderkey < 100) OR price IS NULL ORDER BY price DESC NULLS LAST, o_orderkey DESC LIMIT 51
""")
def keyset_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with null keys last."""
    priced = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"))
    return relational.keyset_page_nulls_last(priced, "price", "o_orderkey", 50, (30000.0, 100))


@query(f"""
WITH q AS (SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus <> 'P') AS top, count(*) AS n FROM orders GROUP BY 1 HAVING bool_or(o_orderpriority = '1-URGENT')),
r AS (SELECT c_custkey, c_name, c_mktsegment, top, n FROM q JOIN customer ON c_custkey = o_custkey WHERE NOT EXISTS (SELECT 1 FROM {_BLOCK} s WHERE s.id = c_custkey OR s.nation = c_nationkey)),
m AS (SELECT c_mktsegment, count(*) AS rarity FROM r GROUP BY 1)
SELECT c_custkey, c_name, top, n, rarity FROM r JOIN m USING (c_mktsegment) ORDER BY top DESC NULLS LAST, c_custkey DESC LIMIT 51
""")
def queue_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review queue: aggregate per business, suppression, rarity over all that pass, first page."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))).alias("top"), F.count("*").alias("n"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("has")).where("has")
    block = table(spark, sf_dir, "supplier").where("s_acctbal < 5000").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") < 2000, F.col("s_nationkey")).alias("nation"))
    customers = relational.any_key_anti(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), block, [("c_custkey", "id"), ("c_nationkey", "nation")])
    passed = customers.join(orders, F.col("c_custkey") == F.col("o_custkey"))
    rarity = passed.groupBy("c_mktsegment").agg(F.count("*").alias("rarity"))
    page = relational.keyset_page_nulls_last(passed.select("c_custkey", "c_name", "c_mktsegment", "top", "n"), "top", "c_custkey", 50)
    return page.join(rarity, "c_mktsegment").select("c_custkey", "c_name", "top", "n", "rarity")


@query("SELECT event_id, user_id, (props->>'k')::INT AS k FROM events WHERE (props->>'k')::INT BETWEEN 10 AND 40")
def json_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter on a JSON path."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("int").alias("k")).where("k between 10 and 40")


@query("SELECT o_custkey, min(o_orderdate) AS first FROM orders GROUP BY 1 HAVING min(o_orderdate) >= (SELECT max(o_orderdate) - INTERVAL 2000 DAY FROM orders)")
def earliest_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers first seen within the last days of the data."""
    orders = table(spark, sf_dir, "orders")
    newest = orders.agg(F.max("o_orderdate").alias("newest"))
    return orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first")).join(F.broadcast(newest), F.expr("first >= newest - interval 2000 days")).select("o_custkey", "first")


@query("""
SELECT lang, doc_id, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id DESC) = 1
""")
def survivorship_min_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER15, ER16: the whole group of fields from the best row of each key."""
    docs = table(spark, sf_dir, "documents").select("lang", "source", "doc_id", "n_chars")
    return relational.newest(docs, ["lang", "source"], ["n_chars", "doc_id"]).select("lang", "doc_id", "source", "n_chars")


@query("""
WITH f AS (SELECT c_custkey % 100 AS business_id, c_custkey AS record_id, CASE c_custkey % 3 WHEN 0 THEN 'google_places' WHEN 1 THEN 'demo_fixture' ELSE 'zeta' END AS source, c_mktsegment, CASE WHEN c_acctbal > 0 THEN c_name END AS name FROM customer),
v AS (SELECT business_id, record_id, source, 'segment' AS field, c_mktsegment AS value FROM f UNION ALL SELECT business_id, record_id, source, 'name', name FROM f)
SELECT business_id, field, value FROM v WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY business_id, field ORDER BY CASE source WHEN 'google_places' THEN 0 WHEN 'demo_fixture' THEN 1 ELSE 2 END, record_id DESC) = 1
""")
def survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER14, ER15, ER18: field values by source priority, then the newest."""
    c = table(spark, sf_dir, "customer")
    source = F.when(F.col("c_custkey") % 3 == 0, "google_places").when(F.col("c_custkey") % 3 == 1, "demo_fixture").otherwise("zeta")
    rows = c.select((F.col("c_custkey") % 100).alias("business_id"), F.col("c_custkey").alias("record_id"), source.alias("source"), F.lit(0).alias("observed_at"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("name"))
    return resolution.survivors(resolution.field_values(rows, ["segment", "name"]))


@query("SELECT p_partkey, p_name, p_brand, p_size::VARCHAR AS p_size FROM part")
def unpivot_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER14: attributes to rows and back."""
    fields = ["p_name", "p_brand", "p_size"]
    return relational.pivot(relational.unpivot(table(spark, sf_dir, "part"), "p_partkey", fields), "p_partkey", fields)


@query("""
WITH o AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN upper(c_name) END AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 2 = 0)
SELECT c_custkey, coalesce(n.c_name, o.c_name) AS c_name, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal FROM o FULL JOIN n USING (c_custkey)
""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1, ST3, F13: only what is supplied changes."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.upper("c_name")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return relational.upsert(c.where("c_custkey % 3 <> 0"), new, ["c_custkey"])


@query("""
WITH a AS (SELECT user_id, min(ts) AS first_seen FROM events GROUP BY 1), b AS (SELECT user_id, event_type, value, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, first_seen, ts AS last_seen, event_type, value FROM a JOIN b USING (user_id)
""")
def seen_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1, ST2, K8: first sighting stays, content follows the last."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("r")).select("user_id", "first_seen", "last_seen", "r.*")


@query("SELECT event_id, user_id, CASE WHEN ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY THEN value END AS value, CASE WHEN ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY THEN props END AS props FROM events")
def retention_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4, ST5: content past its time goes, rows stay."""
    e = table(spark, sf_dir, "events")
    aged = e.join(F.broadcast(e.agg(F.max("ts").alias("newest"))))
    return relational.expired(aged, F.expr("ts < newest - interval 10 days"), ["value", "props"]).select("event_id", "user_id", "value", "props")


@query("""
WITH v AS (SELECT user_id AS business_id, event_id AS record_id, ['phone', 'industry', 'legal_name'][event_id % 3 + 1] AS field, CASE WHEN event_id % 7 <> 0 THEN event_type END AS value, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS source, ts, ts + INTERVAL 20 DAY AS until, (SELECT max(ts) FROM events) - INTERVAL 10 DAY AS now FROM events),
s AS (SELECT business_id, field, value FROM v WHERE until >= now AND value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY business_id, field ORDER BY source, ts DESC, record_id DESC) = 1)
SELECT business_id, max(s.value) FILTER (field = 'phone') AS phone, max(s.value) FILTER (field = 'industry') AS industry, max(s.value) FILTER (field = 'legal_name') AS legal_name, any_value(k.until) AS content_expires_at, any_value(k.n) AS n_purged
FROM (SELECT business_id, min(until) FILTER (until >= now) AS until, count(*) FILTER (until < now) AS n FROM v GROUP BY 1) k LEFT JOIN s USING (business_id) GROUP BY 1
""")
def purged_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4, ER15: what businesses show after the purge of values past their time, recomputed for those alone that it touched."""
    k, e = F.col("event_id"), table(spark, sf_dir, "events")
    newest = e.agg(F.max("ts").alias("t")).head().t
    now = (F.lit(newest) - F.expr("interval 10 days")).cast("timestamp")
    field = F.element_at(F.array(F.lit("phone"), F.lit("industry"), F.lit("legal_name")), (k % 3 + 1).cast("int"))
    source = F.when(k % 5 == 0, "google_places").when(k % 5 == 1, "demo_fixture").otherwise("zeta")
    rows = e.select(F.col("user_id").alias("business_id"), k.alias("record_id"), field.alias("field"), F.when(k % 7 != 0, F.col("event_type")).alias("value"), source.alias("source"), F.col("ts").cast("timestamp").alias("observed_at"), (F.col("ts") + F.expr("interval 20 days")).cast("timestamp").alias("expires_at"), F.lit(None).cast("timestamp").alias("purged_at"))
    fields, tables = ("phone", "industry", "legal_name"), Scratch(spark, "purged_values")
    values = retention.Buckets(spark, f"{tables.root}/values", "business_id", 16).create(rows)
    businesses = retention.Buckets(spark, f"{tables.root}/businesses", "business_id", 16).create(retention.shown(values.read(), fields))
    retention.purge_values(values, businesses, now, fields)
    gone = values.read().groupBy("business_id").agg(F.count_if(F.col("purged_at").isNotNull()).alias("n_purged"))
    return businesses.read().join(gone, "business_id").select("business_id", *fields, "content_expires_at", "n_purged")


@query(r"""
SELECT event_id, CASE WHEN due THEN NULL ELSE value END AS value, CASE WHEN due THEN regexp_replace(props, '("k": *)[0-9]+', '\1null') ELSE props END AS props FROM (SELECT *, ts < (SELECT max(ts) FROM events) - INTERVAL 10 DAY AS due FROM events)
""")
def purged_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5: of rows past their time a column and one key of a JSON text go; the rest of the text stays as written."""
    e = table(spark, sf_dir, "events")
    now = (F.lit(e.agg(F.max("ts").alias("t")).head().t) - F.expr("interval 10 days")).cast("timestamp")
    rows = e.select("event_id", "value", "props", F.col("ts").cast("timestamp").alias("expires_at"), F.lit(None).cast("timestamp").alias("purged_at"))
    return retention.purged(rows, now, ["value"], {"props": ["k"]}).select("event_id", "value", "props")


@query("SELECT l_orderkey, round(least(1 - product(1 - l_discount), 0.95), 3) AS confidence FROM lineitem GROUP BY 1")
def combine_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent signals combined, with a cap."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(scores.combined(F.col("l_discount")).alias("confidence"))


@query("""
SELECT c_custkey, round(0.25::DECIMAL(4,2) * round(CASE WHEN c_acctbal > 0 THEN 1.0::DOUBLE ELSE 0.5 END, 3)::DECIMAL(6,3) + 0.45::DECIMAL(4,2) * round(greatest(0, least(1, c_acctbal / 10000)), 3)::DECIMAL(6,3)
  + 0.1::DECIMAL(4,2) * (c_mktsegment = 'BUILDING')::INT::DECIMAL(6,3) + 0.2::DECIMAL(4,2) * (CASE WHEN c_nationkey > 12 THEN 0.5 ELSE 0 END)::DECIMAL(6,3), 3)::DOUBLE AS score FROM customer
""")
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four weighted parts."""
    parts = {
        "facts": F.when(F.col("c_acctbal") > 0, 1.0).otherwise(0.5), "inference": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c_acctbal") / 10000)),
        "intent": (F.col("c_mktsegment") == "BUILDING").cast("double"), "contactability": F.when(F.col("c_nationkey") > 12, 0.5).otherwise(0.0),
    }
    return table(spark, sf_dir, "customer").select("c_custkey", scores.weighted(parts).alias("score"))


_LAT, _LNG = "((c_custkey * 37) % 18000) / 100.0 - 90", "((c_custkey * 91) % 36000) / 100.0 - 180"


@query(f"""
SELECT c_custkey, round(2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(30.2672 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(30.2672)) * pow(sin(radians(-97.7431 - lng) / 2), 2)))), 1) AS metres
FROM (SELECT c_custkey, ({_LAT})::DOUBLE AS lat, ({_LNG})::DOUBLE AS lng FROM customer)
""")
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5, M6."""
    at = table(spark, sf_dir, "customer").select("c_custkey", F.expr(f"cast({_LAT} as double)").alias("lat"), F.expr(f"cast({_LNG} as double)").alias("lng"))
    return at.select("c_custkey", F.round(geo.distance_m(F.col("lat"), F.col("lng"), F.lit(30.2672), F.lit(-97.7431)), 1).alias("metres"))


@query(r"""
WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\.', '') AS host, lang FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)/', 1) AS lang FROM pages)),
k AS (SELECT page_id, 'host' AS kind, host AS value FROM h UNION ALL SELECT page_id, 'site', regexp_extract(host, '([^.]+\.(com|net|org))$', 1) || '/' || lang FROM h),
m AS (SELECT kind, value, min(page_id) AS head FROM k WHERE value <> '' GROUP BY 1, 2)
SELECT DISTINCT page_id AS record_id, head AS business_id FROM k JOIN m USING (kind, value) WHERE page_id <> head
""")
def blocking_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12, ER1, ER2: each record with the first of each block it is in, by a union of equi keys."""
    host = web.host_of(F.col("url"))
    keyed = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]+)/", 1).alias("lang"))
    site = F.concat(web.registered_domain(F.col("host"), ("com", "net", "org"), ()), F.lit("/"), F.col("lang"))
    keys = keyed.select("page_id", F.inline(F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("value")), F.struct(F.lit("site").alias("kind"), site.alias("value"))))).where("value is not null")
    heads = keys.groupBy("kind", "value").agg(F.min("page_id").alias("business_id"))
    return keys.join(heads, ["kind", "value"]).where("page_id <> business_id").select(F.col("page_id").alias("record_id"), "business_id").distinct()


@query()
def resolve_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER1 to ER10, ER15, ER16: customers as listings; fuzzy and in order, so tested against the sequential replay instead of SQL."""
    ship(spark)
    c = table(spark, sf_dir, "customer")
    name = F.concat(F.lit("shop "), F.lower("c_mktsegment"), F.lit(" "), (F.col("c_custkey") % 700).cast("string"))
    rows = c.select(
        F.col("c_custkey").alias("record_id"), F.col("c_custkey").alias("seq"), F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("s"), F.col("c_custkey") % 350, F.lit(".com"))).alias("domain"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("+1512555"), F.lpad((F.col("c_custkey") % 700).cast("string"), 4, "0"))).alias("phone"),
        name.alias("name"), text.name_key(name).alias("name_key"), F.lpad((F.col("c_nationkey") % 90000).cast("string"), 5, "0").alias("postal"), F.concat((F.col("c_custkey") % 700).cast("string"), F.lit(" main street")).alias("street"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"),
    )
    return resolution.resolve(spark, rows)


@query(r"""
SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', ''), '') AS host, regexp_replace(url, '[?#].*$', '') AS website,
regexp_extract(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', ''), '([^.]+\.(com|net|org))$', 1) AS domain FROM pages
""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8, S9, S12."""
    return table(spark, sf_dir, "pages").select("page_id", web.host_of(F.col("url")).alias("host"), web.clean_url(F.col("url")).alias("website"), web.registered_domain(web.host_of(F.col("url"))).alias("domain"))


@query("""
SELECT kind, count(*) AS n FROM (SELECT CASE page_id % 4 WHEN 0 THEN 'social_profile' WHEN 1 THEN 'builder_subdomain' WHEN 2 THEN 'none' ELSE 'own_site' END AS kind FROM pages) GROUP BY 1
""")
def site_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10, S11."""
    raw = F.when(F.col("page_id") % 4 == 0, "https://www.facebook.com/shop?ref=1").when(F.col("page_id") % 4 == 1, F.concat(F.lit("shop"), F.col("page_id"), F.lit(".wixsite.com/home"))).when(F.col("page_id") % 4 == 2, " ").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select(web.parse_website(raw)["kind"].alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(r"""
SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<h1[ >]'))::INT AS h1_count, len(regexp_extract_all(html, '<script'))::INT AS scripts, len(regexp_extract_all(html, '<a '))::INT AS links, html LIKE '%name="viewport"%' AS viewport FROM pages
""")
def page_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pattern can tell of a page, in one pass."""
    html = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_count(html, F.lit("<h1[ >]")).alias("h1_count"), F.regexp_count(html, F.lit("<script")).alias("scripts"), F.regexp_count(html, F.lit("<a ")).alias("links"), F.contains(html, F.lit('name="viewport"')).alias("viewport")
    )


@query(rf"SELECT doc_id, regexp_replace(text, '{pii.EMAIL}', '[email removed]', 'g') AS text FROM documents")
def pii_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail addresses."""
    return table(spark, sf_dir, "documents").select("doc_id", pii.replaced(F.col("text"), pii.EMAIL).alias("text"))


@query(rf"SELECT doc_id, e AS email FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{pii.EMAIL}')) AS e FROM documents)")
def pii_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S27."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(pii.find(F.col("text"), pii.EMAIL)).alias("email"))


@query("SELECT sha256(text) AS h, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def payload_hash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact repeats by content hash."""
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return hashed.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("""
SELECT user_id, event_id, row_number() OVER w AS n, row_number() OVER w > 5 AS over FROM events WINDOW w AS (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id)
""".replace(" AS over FROM", ' AS "over" FROM').replace("AS n,", "::INT AS n,").replace("row_number() OVER w ::INT", "(row_number() OVER w)::INT"))
def daily_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, K3: running count per user and day, and whether it is over the cap."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return relational.capped(e, ["user_id", "day"], ["ts", "event_id"], 5).select("user_id", "event_id", "n", "over")


@query("""
WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM g
""")
def session_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: sessions that 30 minutes without an event end."""
    return relational.sessions(table(spark, sf_dir, "events"), "user_id", "ts", ["ts", "event_id"], 1800).select("user_id", "event_id", "session")


@query("""
SELECT start, 1 AS level, start // 2 AS ancestor FROM (SELECT o_orderkey AS start FROM orders) WHERE start > 1
UNION ALL SELECT start, 2, start // 4 FROM (SELECT o_orderkey AS start FROM orders) WHERE start > 3 AND start // 2 IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT start, 3, start // 8 FROM (SELECT o_orderkey AS start FROM orders) WHERE start > 7 AND start // 2 IN (SELECT o_orderkey FROM orders) AND start // 4 IN (SELECT o_orderkey FROM orders)
""")
def run_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents of each run over three levels."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") > 1, F.floor(F.col("o_orderkey") / 2).cast("long")).alias("parent"))
    return relational.ancestors(runs, runs, "id", "parent", 3)


@query("""
WITH r AS (SELECT c_custkey AS business_id, c_mktsegment AS service, round(abs(c_acctbal) / 12000, 3) AS confidence FROM customer WHERE c_custkey % 3 <> 0), a AS (SELECT c_custkey AS business_id, c_mktsegment AS service, (c_custkey % 100) / 100.0 AS said FROM customer WHERE c_custkey % 2 = 0)
SELECT business_id, service, CASE WHEN confidence IS NULL THEN 'ai' WHEN said IS NULL THEN 'rules' ELSE 'rules+ai' END AS source,
(CASE WHEN confidence IS NULL THEN round(least(said, 0.6), 3) WHEN said IS NULL THEN confidence ELSE round(greatest(confidence, least(said, confidence + 0.15)), 3) END)::DOUBLE AS confidence, said IS NOT NULL AS ai_agrees FROM r FULL JOIN a USING (business_id, service)
""")
def full_outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and model answers merged."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("business_id"), F.col("c_mktsegment").alias("service"), F.round(F.abs("c_acctbal") / 12000, 3).alias("confidence"), ((F.col("c_custkey") % 100) / 100).alias("said"))
    model = c.where("business_id % 2 = 0").select("business_id", "service", F.col("said").alias("confidence"), F.lit("").alias("rationale"))
    return leads.merge(c.where("business_id % 3 <> 0").select("business_id", "service", "confidence", F.lit("r").alias("reason")), model).drop("reason")


@query("""
SELECT item_id, count(DISTINCT doc_id) AS docs FROM (SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS q FROM benchmark) JOIN (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents) ON contains(t, q) GROUP BY 1
""".replace("\\\\", "\\"))
def verbatim_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold each item verbatim.

    Probes first: of an item's words but its first and last (which a document may hold as parts of longer words) the one
    that the fewest documents have is joined to the documents' distinct words, and only pairs that share it are compared in
    full. No pair is made without a probe, but for items of fewer than three words, if there are any: these, a stated
    set of queries, are held against every text.
    """
    split = lambda c: F.split(c, " ")
    inner = F.slice(split(F.col("q")), F.lit(2), F.greatest(F.size(split(F.col("q"))) - 2, F.lit(0)))
    items = table(spark, sf_dir, "benchmark").select("item_id", text.verbatim(F.col("text")).alias("q")).withColumn("inner", F.array_distinct(inner))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.verbatim(F.col("text")).alias("t"))
    asked = items.select("item_id", F.explode("inner").alias("word"))
    words = Scratch(spark, "quotes").keep(docs.select("doc_id", F.explode(F.array_distinct(split(F.col("t")))).alias("word")).join(asked.select("word").distinct(), "word", "left_semi"), "words")
    seen = words.groupBy("word").agg(F.count("*").alias("n"))
    # a word that no document has is the rarest, and its item is nowhere
    probes = asked.join(seen, "word", "left").groupBy("item_id").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("word"))
    pairs = words.join(probes, "word").select("doc_id", "item_id").distinct()
    met = pairs.join(docs, "doc_id").join(items.select("item_id", "q"), "item_id").where(F.contains("t", "q")).select("item_id", "doc_id")
    short = items.where(F.size("inner") == 0).select("item_id", "q")
    if not short.isEmpty():
        met = met.unionByName(docs.join(short, F.contains("t", "q")).select("item_id", "doc_id"))
    return met.groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"))


@query("SELECT count(*) AS rows, count(*) FILTER (lang IS NULL) AS no_lang, count(*) FILTER (n_chars < 200) AS short, count(DISTINCT source) AS sources FROM documents")
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with conditions in one pass."""
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("rows"), F.count_if(F.col("lang").isNull()).alias("no_lang"), F.count_if(F.col("n_chars") < 200).alias("short"), F.countDistinct("source").alias("sources"))


@query("SELECT lang, list_sort(list(DISTINCT source)) AS sources FROM documents GROUP BY 1".replace("list_sort(list(DISTINCT source)) AS sources", "array_to_string(list_sort(list(DISTINCT source)), ',') AS sources"))
def source_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names in order."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query("""
SELECT o_orderdate::DATE AS day, count(*) AS calls, sum(o_totalprice)::DECIMAL(18,2)::DOUBLE AS spent, greatest(500000 - sum(o_totalprice)::DECIMAL(18,2), 0)::DOUBLE AS remaining FROM orders GROUP BY 1
""")
def usage_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a day has spent of its budget, in decimals."""
    spent = F.sum(F.col("o_totalprice").cast("decimal(18,6)")).cast("decimal(18,2)")
    day = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("calls"), spent.alias("s"))
    return day.select("day", "calls", F.col("s").cast("double").alias("spent"), F.greatest(F.lit(500000) - F.col("s"), F.lit(0)).cast("double").alias("remaining"))


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%1_3%' AND upper(c_mktsegment) = 'BUILDING' AND c_acctbal >= 0")
def list_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """optional filters; wildcards in the search text stay wildcards."""
    return table(spark, sf_dir, "customer").where(F.lower("c_name").like("%1_3%") & (F.upper("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") >= 0)).select("c_custkey", "c_name")


@query("""
SELECT opportunity_id, id, lag(event_type) OVER (PARTITION BY opportunity_id ORDER BY ts, id) AS previous FROM (SELECT user_id AS opportunity_id, event_id AS id, event_type, ts FROM events WHERE value IS NULL OR value < 80)
""")
def previous_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision before each one that stands."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("opportunity_id"), F.col("event_id").alias("id"), F.col("event_type").alias("decision"), F.col("ts").alias("decided_at"), (F.col("value") >= 80).alias("undone"))
    return leads.previous_decision(e).select("opportunity_id", "id", "previous")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'mark_do_not_contact' WHEN o_totalprice < 50000 THEN CASE WHEN o_custkey % 2 = 0 THEN 'withdraw' ELSE 'skip' END WHEN o_orderdate + INTERVAL 30 MINUTE > TIMESTAMP '1998-01-01' THEN 'reschedule' WHEN o_custkey % 2 <> 0 THEN 'create' WHEN o_custkey % 4 = 0 THEN 'unchanged' ELSE 'update' END AS action FROM orders
""")
def sync_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST12: what a delivery does."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "P").alias("suppressed"), (F.col("o_totalprice") >= 50000).alias("approved"), F.col("o_orderdate").alias("decided_at"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("external_id"), F.when(F.col("o_custkey") % 4 == 0, "a").alias("sent_hash"), F.lit("a").alias("new_hash")
    )
    return leads.sync_action(o, F.lit("1998-01-01").cast("timestamp_ntz")).select("o_orderkey", "action")


@query("""
SELECT c_nationkey AS business_id, c_name AS website, c_mktsegment AS domain FROM customer WHERE c_acctbal >= 0
QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 2 END, c_custkey DESC) = 1
""")
def group_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER16: a group of fields from the one best record of each business."""
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_nationkey").alias("business_id"), F.col("c_custkey").alias("record_id"), F.when(F.col("c_custkey") % 2 == 0, "google_places").otherwise("zeta").alias("source"), F.lit(0).alias("observed_at"), F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("website"), F.col("c_mktsegment").alias("domain"))
    rank = F.when(F.col("domain") == "BUILDING", 0).when(F.col("domain") == "MACHINERY", 1).otherwise(2)
    return lifecycle.group_survivors(rows, ("website", "domain"), ("website",), rank)


@query("""
SELECT record_id, business_id, CASE WHEN s.status <> 'pending' THEN s.score ELSE coalesce(f.score, s.score) END AS score, coalesce(s.status, 'pending') AS status
FROM (SELECT o_orderkey AS record_id, o_custkey AS business_id, o_totalprice AS score, CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'kept_apart' END AS status FROM orders WHERE o_orderkey % 2 = 0) s
FULL JOIN (SELECT o_orderkey AS record_id, o_custkey AS business_id, o_totalprice + 1 AS score FROM orders WHERE o_orderkey % 3 = 0) f USING (record_id, business_id)
""")
def candidate_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER11: decided pairs are never reopened."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("business_id"), F.col("o_totalprice").alias("score"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("kept_apart").alias("status"))
    return lifecycle.upsert_candidates(o.where("record_id % 2 = 0"), o.where("record_id % 3 = 0").select("record_id", "business_id", (F.col("score") + 1).alias("score")))


@query("""
WITH m AS (SELECT max(ts) AS now FROM events)
SELECT event_id AS id, 'no heartbeat' AS why FROM events, m WHERE event_type = 'click' AND ts < now - INTERVAL 30 MINUTE
UNION ALL SELECT event_id, 'not in the queue' FROM events, m WHERE event_type = 'view' AND ts < now - INTERVAL 30 MINUTE AND event_id % 7 <> 0
""")
def stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silent runs, and queued ones that no queue holds."""
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))
    status = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "queued").otherwise("done")
    runs = e.select(F.col("event_id").alias("id"), status.alias("status"), F.col("ts").alias("updated_at"), F.col("ts").alias("created_at")).join(F.broadcast(now))
    return reports.stale_runs(runs, runs.where("id % 7 = 0"), F.col("now")).select("id", "why")


@query("""
SELECT o_custkey::VARCHAR AS idempotency_key, o_orderkey AS id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1
""")
def enqueue_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST19: one run a key, the earliest."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("idempotency_key"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return lifecycle.enqueued(o).select("idempotency_key", "id")


@query(r"""
SELECT p_partkey, CASE WHEN regexp_matches(v, '^audit-\d+$') THEN regexp_extract(v, '(\d+)$', 1)::INT END AS version FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'rules' ELSE 'audit-' || p_size END AS v FROM part)
""")
def version_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST20: a number read out of a version text."""
    v = F.when(F.col("p_size") % 3 == 0, "rules").otherwise(F.concat(F.lit("audit-"), F.col("p_size")))
    return table(spark, sf_dir, "part").select("p_partkey", lifecycle.logic_version(v).alias("version"))


@query("""
SELECT a, b, 'delete' AS action FROM (SELECT o_custkey AS a, o_orderkey AS b FROM orders WHERE o_orderkey % 2 = 0 EXCEPT SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 3 = 0)
UNION ALL SELECT a, b, 'insert' FROM (SELECT o_custkey AS a, o_orderkey AS b FROM orders WHERE o_orderkey % 3 = 0 EXCEPT SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 2 = 0)
""")
def link_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to delete and what to insert."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"))
    return relational.sync_links(o.where("b % 2 = 0"), o.where("b % 3 = 0"))


@query("""
WITH c AS (SELECT o_orderkey AS id, [o_custkey % 5, o_custkey % 7] AS cited, [o_orderkey % 5, o_orderkey % 3] AS codes, o_orderstatus FROM orders)
SELECT id, o_orderstatus = 'O' AND NOT list_has_any(cited, codes) AS withdraw FROM c
""")
def withdrawals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1, ST8: pending rows whose cited findings are all gone."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(key.alias("id"), F.array(cust % 5, cust % 7).alias("cited"), F.array(key % 5, key % 3).alias("codes"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("approved").alias("status"), F.lit(None).cast("timestamp").alias("withdrawn_at"))
    return leads.withdrawn(rows).select("id", "withdraw")


@query("SELECT o_orderkey, replace(replace(rtrim(to_base64(encode(o_orderdate::DATE || '|' || o_orderkey)), '='), '+', '-'), '/', '_') AS cursor FROM orders")
def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page cursors."""
    return table(spark, sf_dir, "orders").select("o_orderkey", records.encode_cursor(F.to_date("o_orderdate").cast("string"), F.col("o_orderkey").cast("string")).alias("cursor"))


@query("""
SELECT c_custkey, CASE WHEN floor(c_acctbal) < 0 THEN '''' || floor(c_acctbal)::INT ELSE floor(c_acctbal)::INT::VARCHAR END AS cell FROM customer
""")
def protected_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2: cells that a spreadsheet must not read as formulas."""
    return table(spark, sf_dir, "customer").select("c_custkey", records.protect_cell(F.floor("c_acctbal").cast("int")).alias("cell"))


@query("""
SELECT l_orderkey, sum(l_quantity * 1000)::BIGINT AS tokens, round(sum(l_quantity * 1000)::DECIMAL(18,0) * 0.15 / 1000000, 6)::DOUBLE AS cost FROM lineitem GROUP BY 1
""")
def model_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost in decimals, half up."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum((F.col("l_quantity") * 1000).cast("long")).alias("tokens"))
    return t.select("l_orderkey", "tokens", scores.estimate_cost(F.col("tokens"), F.lit("0.15"), F.lit(0), F.lit("0")).cast("double").alias("cost"))


@query("""
SELECT c_custkey, greatest(3600, (c_custkey % 40) * 210)::INT AS seconds, pow(2, greatest(c_custkey % 6, 1))::DOUBLE AS backoff FROM customer
""")
def limits_and_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST21, M15."""
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", lifecycle.time_limit(c % 40).cast("int").alias("seconds"), scores.backoff_seconds(F.lit(2), (c % 6)).cast("double").alias("backoff"))
