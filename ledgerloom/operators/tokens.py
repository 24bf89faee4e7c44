"""Tokens that pass for others, and addresses that are made to look like a counterparty.

Assets are told by contract, never by symbol: the symbol is what a forger chooses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import scripts, skeleton

#: Contracts that carry a symbol on a chain; none for native assets, which have no contract.
CANONICAL = {
    ("eip155:1", "DAI"): ("0x6b175474e89094c44da98b954eedeac495271d0f",),
    ("eip155:1", "ETH"): (),
    ("eip155:1", "USDC"): ("0xa0b86991c6218b36c1d19d4a2e9eb0ce3606eb48",),
    ("eip155:1", "USDT"): ("0xdac17f958d2ee523a2206206994597c13d831ec7",),
    ("eip155:1", "WBTC"): ("0x2260fac5e5542a773aa44fbcfedf7c193bc2c599",),
    ("eip155:1", "WETH"): ("0xc02aaa39b223fe8d0a0e5c4f27ead9083c756cc2",),
    ("eip155:137", "USDC"): ("0x3c499c542cef5e3811e1192ce70d8cc03d5c3359",),
    ("eip155:137", "USDT"): ("0xc2132d05d31c914a87c6611c10748aeb04b58e8f",),
    ("eip155:42161", "USDC"): ("0xaf88d065e77c8cc2239327c5edb3a432268e5831",),
    ("eip155:42161", "USDT"): ("0xfd086bc7cd5c481dcc9c85ebe478a1c0b69fcbb9",),
    ("eip155:56", "BNB"): (),
    ("eip155:56", "USDC"): ("0x8ac76a51cc950d9822d68b83fe1ad97b32cd580d",),
    ("eip155:56", "USDT"): ("0x55d398326f99059ff775485246999027b3197955",),
    ("eip155:8453", "USDC"): ("0x833589fcd6edb6e08f4c7c32d4f71b54bda02913",),
}


def canonical(spark: SparkSession, more: dict | None = None) -> DataFrame:
    """(chain, known, contracts): the built-in registry, and entries of one's own that add to it."""
    table = {k: {*v} for k, v in CANONICAL.items()}
    for (chain, symbol), contracts in (more or {}).items():
        table.setdefault((chain, symbol.strip().upper()), set()).update(c.strip().lower() for c in contracts)
    rows = [(chain, symbol, sorted(contracts)) for (chain, symbol), contracts in sorted(table.items())]
    return spark.createDataFrame(rows, "chain string, known string, contracts array<string>")


def inspected(ledger: DataFrame, more: dict | None = None) -> DataFrame:
    """(chain, contract, symbol, transfers, verdict, resembles) of each asset. The verdict, in this order: genuine (its
    symbol's contract, or native without one), forged (a registered symbol from elsewhere), lookalike (reads like a
    registered symbol), unknown-script (mixed or other writing systems), unlisted (nothing is claimed)."""
    spark = ledger.sparkSession
    contract, symbol = F.lower(F.trim(F.coalesce("asset", F.lit("")))), F.trim(F.coalesce("symbol", F.lit("")))
    assets = ledger.groupBy("chain", contract.alias("contract"), symbol.alias("symbol")).agg(F.count("*").alias("transfers"))
    assets = assets.withColumns({"upper": F.upper("symbol"), "looks": F.upper(F.trim(skeleton(F.col("symbol")))), "scripts": scripts(F.col("symbol"))})
    table = F.broadcast(canonical(spark, more))  # fixed values and entries typed by the user
    own = table.select("chain", F.col("known").alias("upper"), "contracts")
    alike = table.select("chain", F.col("known").alias("looks"), F.col("known").alias("alike"))
    got = assets.join(own, ["chain", "upper"], "left").join(alike, ["chain", "looks"], "left")
    known = F.col("contracts").isNotNull()
    genuine = known & F.when(F.col("contract") == "", F.size("contracts") == 0).otherwise(F.array_contains("contracts", F.col("contract")))
    resembles = F.when(known & ~genuine, F.col("upper")).when(~known & (F.col("alike") != F.col("upper")), F.col("alike")).otherwise("")
    odd = (F.size("scripts") > 1) | F.col("symbol").rlike(r"[^\x00-\x7F]")
    verdict = F.when(genuine, "genuine").when(known, "forged").when(resembles != "", "lookalike").when(odd, "unknown-script").otherwise("unlisted")
    return got.select("chain", "contract", "symbol", "transfers", verdict.alias("verdict"), F.coalesce(resembles, F.lit("")).alias("resembles"))


def trusted_assets(ledger: DataFrame, more: dict | None = None) -> DataFrame:
    """(chain, contract) whose transfers may be taken at face value: native, genuine, or any registered contract."""
    found = inspected(ledger, more)
    listed = canonical(ledger.sparkSession, more).select("chain", F.explode("contracts").alias("contract")).withColumn("listed", F.lit(True))
    got = found.join(F.broadcast(listed), ["chain", "contract"], "left")
    return got.where("contract = '' or verdict = 'genuine' or listed").select("chain", "contract").distinct()


def sightings(ledger: DataFrame, trusted: DataFrame) -> DataFrame:
    """Per (address, other): payments sent in trusted assets, claims of payments in others (a contract's author writes
    its logs), received, without value, all, and first and last moment."""
    # a registry's contracts and native assets: few, and joined by hash each contract's transfers would be one task
    believed = F.broadcast(trusted.select("chain", F.col("contract").alias("_contract"), F.lit(True).alias("_ok")))
    moves = ledger.where("sender <> recipient").withColumn("_contract", F.lower(F.trim(F.coalesce("asset", F.lit(""))))).join(believed, ["chain", "_contract"], "left")
    ok, up = F.coalesce("_ok", F.lit(False)), F.col("sender") < F.col("recipient")
    # both directions of two addresses are one group, whose two readings are made of its counts afterwards
    pairs = moves.groupBy(F.least("sender", "recipient").alias("a"), F.greatest("sender", "recipient").alias("b")).agg(
        F.count_if(up & ok).alias("up"), F.count_if(up & ~ok).alias("up_untrusted"), F.count_if(~up & ok).alias("down"), F.count_if(~up & ~ok).alias("down_untrusted"),
        F.count_if(F.col("amount_raw") == 0).alias("zero_value"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )

    def seen_by(address: str, other: str, out: str, back: str) -> Column:
        return F.struct(F.col(address).alias("address"), F.col(other).alias("other"), F.col(out).alias("sent"), F.col(f"{out}_untrusted").alias("sent_untrusted"), (F.col(back) + F.col(f"{back}_untrusted")).alias("received"))

    total = F.col("up") + F.col("up_untrusted") + F.col("down") + F.col("down_untrusted")
    each = F.explode(F.array(seen_by("a", "b", "up", "down"), seen_by("b", "a", "down", "up"))).alias("s")
    return pairs.select(each, "zero_value", total.alias("total"), "first_ts", "last_ts").select("s.*", "zero_value", "total", "first_ts", "last_ts")


def lookalikes(seen: DataFrame, edges: int = 4) -> DataFrame:
    """Per address its counterparties that share their first and last `edges` digits: how many, how many of them it paid,
    and whether that tells which one was meant (exactly one paid, others not)."""
    body = F.regexp_replace("other", "^0x", "")
    rows = seen.withColumn("body", body).where(F.length("body") >= 2 * edges)
    rows = rows.withColumns({"prefix": F.substring("body", 1, edges), "suffix": F.right("body", F.lit(edges))})
    got = rows.groupBy("address", "prefix", "suffix").agg(F.count("*").alias("members"), F.count_if(F.col("sent") > 0).alias("paid"), F.sum("sent_untrusted").alias("claimed"), F.min(F.when(F.col("sent") > 0, F.col("other"))).alias("first_paid"))
    sure = (F.col("paid") == 1) & (F.col("members") > 1)
    return got.where("members > 1").select("address", "prefix", "suffix", "members", "paid", "claimed", sure.alias("decidable"), F.when(sure, F.col("first_paid")).alias("meant"))
