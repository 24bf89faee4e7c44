"""Ledger-shaped views over the driver's tables, as DataFrames and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHAIN = "eip155:1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers out of events: user pays user k, amounts in cents, the event type is the asset (view: native)."""
    e = table(spark, sf_dir, "events")
    native = F.col("event_type") == "view"
    return e.select(
        F.lit(CHAIN).alias("chain"),
        F.concat(F.lit("tx"), F.col("event_id")).alias("tx_hash"),
        F.lit(0).alias("log_index"),
        F.concat(F.lit("u"), F.col("user_id")).alias("sender"),
        F.concat(F.lit("u"), F.get_json_object("props", "$.k")).alias("recipient"),
        F.round(F.col("value") * 100).cast("decimal(38,0)").alias("amount_raw"),
        F.lit(2).alias("decimals"),
        F.col("event_type").alias("symbol"),
        F.when(~native, F.col("event_type")).alias("asset"),
        F.when(native, "native").otherwise("token").alias("kind"),
        F.col("event_id").alias("block"),
        epoch(F.col("ts")).alias("ts"),
    )


LEDGER = """ledger AS (
  SELECT 'eip155:1' AS chain, 'tx' || event_id AS tx_hash, 0 AS log_index, 'u' || user_id AS sender, 'u' || (props->>'k') AS recipient,
         CAST(round(value * 100) AS DECIMAL(38,0)) AS amount_raw, 2 AS decimals, event_type AS symbol,
         CASE WHEN event_type <> 'view' THEN event_type END AS asset, CASE WHEN event_type = 'view' THEN 'native' ELSE 'token' END AS kind,
         event_id AS block, CAST(floor(epoch(ts)) AS BIGINT) AS ts
  FROM events)"""


def hub_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with one recipient for each asset, so that sequences between two parties are long."""
    return ledger(spark, sf_dir).withColumn("recipient", F.concat(F.lit("hub_"), F.col("symbol")))


HUB = LEDGER + """,
hub AS (SELECT * REPLACE ('hub_' || symbol AS recipient) FROM ledger)"""


def gappy_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with mints (no sender), burns (no recipient) and undated rows."""
    return ledger(spark, sf_dir).withColumns({
        "sender": F.when(F.col("block") % 97 != 0, F.col("sender")),
        "recipient": F.when(F.col("block") % 89 != 0, F.col("recipient")),
        "ts": F.when(F.col("block") % 83 != 0, F.col("ts")),
    })


GAPPY = LEDGER + """,
gappy AS (SELECT * REPLACE (CASE WHEN block % 97 <> 0 THEN sender END AS sender, CASE WHEN block % 89 <> 0 THEN recipient END AS recipient,
          CASE WHEN block % 83 <> 0 THEN ts END AS ts) FROM ledger)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribution claims out of customers, and a second source that sometimes disagrees."""
    c = table(spark, sf_dir, "customer")
    first = c.select(
        F.concat(F.lit("u"), F.col("c_custkey")).alias("address"),
        F.when(F.col("c_custkey") % 7 != 0, F.lit(CHAIN)).alias("chain"),
        F.col("c_name").alias("label"),
        F.expr("CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'cex' WHEN 'BUILDING' THEN 'mixer' WHEN 'FURNITURE' THEN 'scam' WHEN 'MACHINERY' THEN 'bridge' ELSE 'unknown' END").alias("category"),
        (F.col("c_custkey") % 5).cast("int").alias("confidence"),
        F.lit("crm").alias("source"),
        (F.col("c_custkey") * 1000).alias("observed_at"),
    )
    second = c.where("c_custkey % 3 = 0").select(
        F.concat(F.lit("u"), F.col("c_custkey")).alias("address"),
        F.lit(None).cast("string").alias("chain"),
        F.concat(F.lit("list "), F.col("c_nationkey")).alias("label"),
        F.when(F.col("c_custkey") % 2 == 0, "sanctioned").otherwise("cex").alias("category"),
        (F.lit(4) - F.col("c_custkey") % 4).cast("int").alias("confidence"),
        F.lit("list").alias("source"),
        (F.col("c_custkey") * 10).alias("observed_at"),
    )
    return first.unionByName(second)


CLAIMS = """claims AS (
  SELECT 'u' || c_custkey AS address, CASE WHEN c_custkey % 7 <> 0 THEN 'eip155:1' END AS chain, c_name AS label,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'cex' WHEN 'BUILDING' THEN 'mixer' WHEN 'FURNITURE' THEN 'scam' WHEN 'MACHINERY' THEN 'bridge' ELSE 'unknown' END AS category,
         CAST(c_custkey % 5 AS INTEGER) AS confidence, 'crm' AS source, c_custkey * 1000 AS observed_at FROM customer
  UNION ALL
  SELECT 'u' || c_custkey, NULL, 'list ' || c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN 'sanctioned' ELSE 'cex' END,
         CAST(4 - c_custkey % 4 AS INTEGER), 'list', c_custkey * 10 FROM customer WHERE c_custkey % 3 = 0)"""


def expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).where(F.substring("sender", 2, 20).cast("long") % 3 == 0).select(F.col("sender").alias("address"), "chain").distinct()


EXPANDED = "expanded AS (SELECT DISTINCT sender AS address, chain FROM ledger WHERE CAST(substr(sender, 2) AS BIGINT) % 3 = 0)"


def klines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, minute_no, close_px): the last event's value in each minute."""
    e = table(spark, sf_dir, "events").withColumn("minute_no", F.floor(epoch(F.col("ts")) / 60))
    return e.groupBy(F.concat(F.col("event_type"), F.lit("USDT")).alias("symbol"), "minute_no").agg(F.max_by(F.col("value").cast("decimal(18,4)"), "event_id").alias("close_px")).where("close_px > 0")


KLINES = """klines AS (SELECT * FROM (SELECT event_type || 'USDT' AS symbol, CAST(floor(epoch(ts) / 60) AS BIGINT) AS minute_no, arg_max(CAST(value AS DECIMAL(18,4)), event_id) AS close_px
  FROM events GROUP BY 1, 2) WHERE close_px > 0)"""


def token_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("token"), F.col("p_partkey").alias("block"), (F.col("p_size") % 19).alias("decimals"))


DECIMALS = "token_decimals AS (SELECT p_brand AS token, p_partkey AS block, p_size % 19 AS decimals FROM part)"


def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tx, recipient, amount_raw): what each order pays to each supplier."""
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("decimal(38,0)").alias("a"))
    return i.groupBy(F.col("l_orderkey").alias("tx"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("recipient")).agg(F.sum("a").alias("amount_raw"))


DISTRIBUTIONS = """distributions AS (SELECT l_orderkey AS tx, 's' || l_suppkey AS recipient, CAST(sum(CAST(round(l_extendedprice * 100) AS DECIMAL(38,0))) AS DECIMAL(38,0)) AS amount_raw
  FROM lineitem GROUP BY 1, 2)"""


def utxo_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("txid"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("address")).distinct()


def utxo_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    script = F.expr("CASE l_returnflag WHEN 'A' THEN 'p2pkh' WHEN 'N' THEN 'p2wpkh' ELSE 'p2tr' END")
    return i.select(F.col("l_orderkey").alias("txid"), F.col("l_linenumber").alias("idx"), F.concat(F.lit("s"), F.col("l_partkey") % 50).alias("address"), (F.col("l_quantity") * 100).cast("long").alias("amount"), script.alias("script"))


UTXO = """inputs AS (SELECT DISTINCT l_orderkey AS txid, 's' || l_suppkey AS address FROM lineitem),
outputs AS (SELECT l_orderkey AS txid, l_linenumber AS idx, 's' || (l_partkey % 50) AS address, CAST(l_quantity * 100 AS BIGINT) AS amount,
  CASE l_returnflag WHEN 'A' THEN 'p2pkh' WHEN 'N' THEN 'p2wpkh' ELSE 'p2tr' END AS script FROM lineitem)"""


def pool_events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(pool, tx, block, idx, address) of deposits (purchases) or withdrawals (signups)."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.select((F.col("user_id") % 5).alias("pool"), F.concat(F.lit("tx"), F.col("event_id")).alias("tx"), F.col("event_id").alias("block"), F.lit(0).alias("idx"), F.concat(F.lit("u"), F.col("user_id")).alias("address"))


POOLS = """deposits AS (SELECT user_id % 5 AS pool, 'tx' || event_id AS tx, event_id AS block, 0 AS idx, 'u' || user_id AS address FROM events WHERE event_type = 'purchase'),
withdrawals AS (SELECT user_id % 5 AS pool, 'tx' || event_id AS tx, event_id AS block, 0 AS idx, 'u' || user_id AS address FROM events WHERE event_type = 'signup')"""


def relays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of relays: each order pays an account of its own, which pays on, some of them less by up to 1.5 %."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    rest = F.col("cents") - F.floor(F.col("cents") * (F.col("o_orderkey") % 4) * 50 / 10000).cast("long")
    common = [F.lit(CHAIN).alias("chain"), F.lit(0).alias("log_index"), F.lit("USD").alias("asset")]
    paid = o.select(*common, F.concat(F.lit("in"), F.col("o_orderkey")).alias("tx_hash"), F.concat(F.lit("c"), F.col("o_custkey")).alias("sender"), F.concat(F.lit("r"), F.col("o_orderkey")).alias("recipient"), F.col("cents").cast("decimal(38,0)").alias("amount_raw"), (F.col("o_orderkey") * 2).alias("block"))
    on = o.select(*common, F.concat(F.lit("out"), F.col("o_orderkey")).alias("tx_hash"), F.concat(F.lit("r"), F.col("o_orderkey")).alias("sender"), F.concat(F.lit("m"), F.col("o_custkey") % 10).alias("recipient"), rest.cast("decimal(38,0)").alias("amount_raw"), (F.col("o_orderkey") * 2 + 1).alias("block"))
    return paid.unionByName(on)


RELAYS = """o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
relays AS (SELECT 'in' || k AS tx_hash, 'c' || c AS sender, 'r' || k AS recipient, cents AS amount_raw, k * 2 AS block FROM o
  UNION ALL SELECT 'out' || k, 'r' || k, 'm' || (c % 10), cents - CAST(floor(cents * (k % 4) * 50 / 10000) AS BIGINT), k * 2 + 1 FROM o)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers of tokens that imitate others: each line item moves one from a supplier to a part's address."""
    i = table(spark, sf_dir, "lineitem")
    n = F.col("l_partkey") % 8
    symbol = F.expr("CASE l_partkey % 8 WHEN 0 THEN 'USDC' WHEN 1 THEN 'USDC' WHEN 2 THEN 'UЅDC' WHEN 3 THEN 'ЕТН' WHEN 4 THEN 'ETH' WHEN 5 THEN 'ETH' WHEN 6 THEN 'ORDER' ELSE 'ÜBER' END")
    asset = F.expr("CASE l_partkey % 8 WHEN 0 THEN '0xa0b86991c6218b36c1d19d4a2e9eb0ce3606eb48' WHEN 4 THEN NULL ELSE concat('0xf0', l_partkey % 8) END")
    body = F.md5((F.col("l_partkey") % 300).cast("string").cast("binary"))
    address = F.concat(F.lit("0x"), F.substring(F.md5((F.col("l_partkey") % 40).cast("string").cast("binary")), 1, 4), F.substring(body, 5, 8), F.substring(F.md5((F.col("l_partkey") % 40).cast("string").cast("binary")), 5, 4))
    us = F.concat(F.lit("s"), F.col("l_suppkey"))
    out = (n < 5) & (F.col("l_linenumber") % 2 == 0)
    return i.select(F.lit(CHAIN).alias("chain"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("tx_hash"), F.lit(0).alias("log_index"), F.when(out, us).otherwise(address).alias("sender"), F.when(out, address).otherwise(us).alias("recipient"), F.when(n == 6, F.lit(0)).otherwise((F.col("l_quantity") * 100).cast("long")).cast("decimal(38,0)").alias("amount_raw"), symbol.alias("symbol"), asset.alias("asset"), F.col("l_orderkey").alias("block"), epoch(F.col("l_shipdate")).alias("ts"))


TOKENS = """tokens AS (SELECT sender, recipient, amount_raw, symbol, asset, ts FROM (SELECT
  CASE l_partkey % 8 WHEN 0 THEN 'USDC' WHEN 1 THEN 'USDC' WHEN 2 THEN 'UЅDC' WHEN 3 THEN 'ЕТН' WHEN 4 THEN 'ETH' WHEN 5 THEN 'ETH' WHEN 6 THEN 'ORDER' ELSE 'ÜBER' END AS symbol,
  CASE l_partkey % 8 WHEN 0 THEN '0xa0b86991c6218b36c1d19d4a2e9eb0ce3606eb48' WHEN 4 THEN NULL ELSE '0xf0' || (l_partkey % 8) END AS asset,
  '0x' || substr(md5((l_partkey % 40)::VARCHAR), 1, 4) || substr(md5((l_partkey % 300)::VARCHAR), 5, 8) || substr(md5((l_partkey % 40)::VARCHAR), 5, 4) AS a, 's' || l_suppkey AS us,
  l_partkey % 8 < 5 AND l_linenumber % 2 = 0 AS outward, CASE WHEN outward THEN us ELSE a END AS sender, CASE WHEN outward THEN a ELSE us END AS recipient,
  CAST(CASE WHEN l_partkey % 8 = 6 THEN 0 ELSE CAST(l_quantity * 100 AS BIGINT) END AS DECIMAL(38,0)) AS amount_raw, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS ts FROM lineitem))"""


def label_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rows of an imported file: all text, headers of its own, some rows broken; `ord` is the row's place."""
    return table(spark, sf_dir, "customer").selectExpr(
        "CASE WHEN c_custkey % 41 = 0 THEN ' ' ELSE concat('U', c_custkey % 700) END AS Wallet", "CASE WHEN c_custkey % 43 = 0 THEN NULL ELSE concat('party ', c_custkey % 300) END AS name",
        "CASE c_custkey % 6 WHEN 0 THEN 'Exchange' WHEN 1 THEN ' tumbler' WHEN 2 THEN 'OFAC' WHEN 3 THEN 'phishing' WHEN 4 THEN 'dex' ELSE 'shop' END AS type",
        "CASE c_custkey % 5 WHEN 0 THEN 'High' WHEN 1 THEN '1' WHEN 2 THEN '' WHEN 3 THEN 'guess' ELSE CASE WHEN c_custkey % 47 = 0 THEN '9' ELSE 'certain' END END AS certainty", "c_custkey AS ord",
    )


LABELS = """imported AS (SELECT nullif(trim(CASE WHEN c_custkey % 41 = 0 THEN ' ' ELSE 'U' || (c_custkey % 700) END), '') AS address, CASE WHEN c_custkey % 43 = 0 THEN NULL ELSE 'party ' || (c_custkey % 300) END AS label,
  CASE c_custkey % 6 WHEN 0 THEN 'cex' WHEN 1 THEN 'mixer' WHEN 2 THEN 'sanctioned' WHEN 3 THEN 'illicit' WHEN 4 THEN 'dex' ELSE 'unknown' END AS category,
  CASE c_custkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 0 ELSE CASE WHEN c_custkey % 47 = 0 THEN 9 ELSE 4 END END AS sure, c_custkey AS ord FROM customer),
labels_in AS (SELECT ord, address, label, category, CAST(least(sure, 3) AS INTEGER) AS confidence, CASE WHEN address IS NULL THEN 'no address' WHEN label IS NULL THEN 'no label' WHEN sure > 4 THEN 'bad confidence' END AS problem FROM imported)"""
