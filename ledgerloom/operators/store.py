"""Typed scans, edges, flows and totals over a ledger of transfers; idempotent writes.

Amounts are DECIMAL(38,0): sums are exact and raise on overflow. A null asset is the native one and groups as a key.
Limited results are ordered totally (…, tx_hash, log_index), so that pages are stable.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RAW = "decimal(38,0)"
IDENTITY = ("chain", "tx_hash", "log_index", "sender", "recipient", "amount_raw", "asset", "kind")


@dataclass(frozen=True)
class Scan:
    """A conjunctive filter with order and page. `address` is either side and excludes the other two."""

    chain: str | None = None
    sender: str | None = None
    recipient: str | None = None
    address: str | None = None
    asset: str | None = None
    min_raw: int | None = None
    max_raw: int | None = None
    after: int | None = None
    before: int | None = None
    from_block: int | None = None
    to_block: int | None = None
    kinds: tuple[str, ...] = ()
    order: str = "time"
    limit: int | None = None
    offset: int = 0

    def __post_init__(self) -> None:
        if self.address and (self.sender or self.recipient):
            raise ValueError("address excludes sender and recipient")
        if self.order not in ("time", "block", "amount"):
            raise ValueError(f"unknown order: {self.order}")

    def condition(self) -> Column:
        c = F.col
        tests = [F.lit(True)]
        tests += [c(name) == value for name, value in (("chain", self.chain), ("sender", self.sender), ("recipient", self.recipient), ("asset", self.asset)) if value is not None]
        if self.address is not None:
            tests.append((c("sender") == self.address) | (c("recipient") == self.address))
        for name, low, high in (("amount_raw", self.min_raw, self.max_raw), ("ts", self.after, self.before), ("block", self.from_block, self.to_block)):
            tests += [c(name) >= low] if low is not None else []
            tests += [c(name) <= high] if high is not None else []
        if self.kinds:
            tests.append(c("kind").isin(*self.kinds))
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


def scan(ledger: DataFrame, q: Scan) -> DataFrame:
    rows = ledger.where(q.condition())
    if q.limit is None and not q.offset:
        return rows
    first = {"time": F.col("ts").asc_nulls_first(), "block": F.col("block").asc_nulls_first(), "amount": F.col("amount_raw").desc_nulls_last()}[q.order]
    rows = rows.orderBy(first, "tx_hash", "log_index").offset(q.offset)
    return rows.limit(q.limit) if q.limit is not None else rows


def count(ledger: DataFrame, q: Scan) -> DataFrame:
    return ledger.where(q.condition()).agg(F.count("*").alias("n"))


def capped(rows: DataFrame, limit: int) -> DataFrame:
    """At most `limit` rows, each with whether there were more: a bounded answer says so."""
    some = rows.limit(limit + 1).withColumn("_i", F.row_number().over(Window.orderBy(F.lit(1))))
    return some.withColumn("truncated", F.max("_i").over(Window.partitionBy(F.lit(1))) > limit).where(F.col("_i") <= limit).drop("_i")


def edges(ledger: DataFrame, direction: str = "out", min_total: int = 0) -> DataFrame:
    """Per (subject, counterparty, asset) of one chain: exact total, count, span; symbol of the first row."""
    subject, other = ("sender", "recipient") if direction == "out" else ("recipient", "sender")
    rows = ledger.where(F.col("sender").isNotNull() & F.col("recipient").isNotNull())
    got = rows.groupBy("chain", F.col(subject).alias("subject"), F.col(other).alias("counterparty"), "asset").agg(
        F.sum("amount_raw").cast(RAW).alias("total_raw"), F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min_by("symbol", F.struct("block", "log_index", "tx_hash")).alias("symbol"),
    )
    return got.where(F.col("total_raw") >= min_total)


def flows(ledger: DataFrame, min_total: int = 0, limit: int | None = None) -> DataFrame:
    """The other grain of edges: symbol and chain are keys too."""
    keys = ("sender", "recipient", "asset", "symbol", "chain")
    got = ledger.groupBy(*keys).agg(F.sum("amount_raw").cast(RAW).alias("total_raw"), F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).where(F.col("total_raw") >= min_total)
    return got.orderBy(F.desc("total_raw"), *keys).limit(limit) if limit is not None else got


def totals_by_asset(ledger: DataFrame, address: str | None = None, direction: str = "out") -> DataFrame:
    rows = ledger if address is None else ledger.where(F.col("sender" if direction == "out" else "recipient") == address)
    return rows.groupBy("chain", "asset", "symbol").agg(F.sum("amount_raw").cast(RAW).alias("total_raw"), F.count("*").alias("n"))


def sides(ledger: DataFrame) -> DataFrame:
    """Each transfer once for each of its known ends: (address, other, outgoing, …)."""
    rest = [c for c in ledger.columns if c not in ("sender", "recipient")]
    out = ledger.where("sender is not null").select(F.col("sender").alias("address"), F.col("recipient").alias("other"), F.lit(True).alias("outgoing"), *rest)
    return out.unionByName(ledger.where("recipient is not null").select(F.col("recipient").alias("address"), F.col("sender").alias("other"), F.lit(False).alias("outgoing"), *rest))


def counterparties(ledger: DataFrame) -> DataFrame:
    """Per (address, other): transfers in both directions, and distinct assets."""
    return sides(ledger).where("other is not null").groupBy("address", "other").agg(F.count("*").alias("n"), F.countDistinct(F.coalesce("asset", "symbol")).alias("assets"))


def addresses(ledger: DataFrame) -> DataFrame:
    return ledger.select(F.col("sender").alias("address")).union(ledger.select("recipient")).where("address is not null").distinct()


def stats(ledger: DataFrame, claims: DataFrame) -> DataFrame:
    rows = ledger.agg(F.count("*").alias("transfers"), F.countDistinct("chain").alias("chains"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return rows.join(addresses(ledger).agg(F.count("*").alias("addresses"))).join(claims.agg(F.count("*").alias("claims")))


def frontier(ledger: DataFrame, expanded: DataFrame) -> DataFrame:
    """Addresses seen on a chain but not expanded there."""
    ends = ledger.select("chain", F.col("sender").alias("address")).union(ledger.select("chain", "recipient")).where("address is not null").distinct()
    return ends.join(expanded, ["chain", "address"], "left_anti")


def new_transfers(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of `incoming` that an idempotent write adds: one for each identity. Rows without sender or recipient
    (mints, burns) have no identity and are all added; a null asset equals a null asset."""
    known = F.col("sender").isNotNull() & F.col("recipient").isNotNull()
    key = [F.coalesce(F.col(c), F.lit("")).alias(c) if c == "asset" else F.col(c) for c in IDENTITY]
    once = incoming.where(known).dropDuplicates(list(IDENTITY))
    old = existing.where(known).select(*key).distinct()
    a, b = once.alias("a"), old.alias("b")
    same = [F.coalesce(F.col("a.asset"), F.lit("")) == F.col("b.asset"), *[F.col(f"a.{c}") == F.col(f"b.{c}") for c in IDENTITY if c != "asset"]]
    return a.join(b, same, "left_anti").unionByName(incoming.where(~known))


def latest(marks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert-or-replace: the last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return marks.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def strongest(edges_: DataFrame, k: int) -> DataFrame:
    """k edges of each subject, fairly over assets: best of each asset first, then second bests; at the same rank the
    asset with more edges first. Raw amounts of different assets are never compared."""
    a = F.coalesce("asset", F.lit(""))
    of_asset = Window.partitionBy("subject", a)
    ranked = edges_.withColumn("rank", F.row_number().over(of_asset.orderBy(F.desc("total_raw"), "counterparty"))).withColumn("group_size", F.count("*").over(of_asset))
    turn = Window.partitionBy("subject").orderBy("rank", F.desc("group_size"), a)
    return ranked.withColumn("place", F.row_number().over(turn)).where(F.col("place") <= k)


def dust_floor(edges_: DataFrame, share: float = 1e-6) -> DataFrame:
    """Edges per subject and asset with whether they are below the floor max * share (as an integer)."""
    most = F.max("total_raw").over(Window.partitionBy("subject", "asset"))
    return edges_.withColumn("dust", F.col("total_raw") < F.floor(most * F.lit(share).cast("decimal(10,8)")))


def sift(edges_: DataFrame, asset: str | None = None, since: int | None = None, until: int | None = None, min_raw: int = 0) -> DataFrame:
    """How many edges a filter keeps and drops; the asset matches contract or symbol, without case."""
    keep = F.col("total_raw") >= min_raw
    if asset is not None:
        keep = keep & F.coalesce((F.lower("asset") == asset.lower()) | (F.lower("symbol") == asset.lower()), F.lower("symbol") == asset.lower())
    if since is not None:
        keep = keep & (F.col("last_ts") >= since)
    if until is not None:
        keep = keep & (F.col("first_ts") <= until)
    return edges_.agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"))


def corroborate(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Union of two sources by key, with where each row was seen."""
    a = left.select(*key).distinct().withColumn("_a", F.lit(True))
    b = right.select(*key).distinct().withColumn("_b", F.lit(True))
    seen = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "first").otherwise("second")
    return a.join(b, key, "full_outer").select(*key, seen.alias("seen_in"))


def unit_total(amounts: DataFrame) -> DataFrame:
    """Sum that refuses mixed units: null with mixed = true instead of a number that means nothing."""
    units = F.count_distinct("decimals", "symbol")
    return amounts.agg(F.when(units <= 1, F.sum("amount_raw")).cast(RAW).alias("total_raw"), (units > 1).alias("mixed"))


def panels(ledger: DataFrame, claims: DataFrame) -> DataFrame:
    """A case's dashboard as rows (panel, key, n, total_raw, first_ts, last_ts), two scans for all of it: the ledger by asset,
    by chain and as a whole, the claims by category, by source, of low confidence and as a whole (grouping sets)."""
    unit = F.concat_ws("|", "chain", F.coalesce("asset", F.lit("")), "symbol", F.col("decimals").cast("string"))
    rows = ledger.select("chain", unit.alias("unit"), "amount_raw", "ts")
    held = rows.groupingSets([("unit",), ("chain",), ()], "unit", "chain").agg(F.grouping_id("unit", "chain").alias("g"), F.count("*").alias("n"), F.sum("amount_raw").cast(RAW).alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    by_unit = F.col("g") == 1
    money = held.select(F.when(by_unit, "asset").when(F.col("g") == 2, "chain").otherwise("ledger").alias("panel"), F.coalesce("unit", "chain", F.lit("")).alias("key"), "n", F.when(by_unit, F.col("total")).alias("total_raw"), "first_ts", "last_ts")
    said = claims.select("category", "source", (F.col("confidence") <= 1).alias("low"))
    counted = said.groupingSets([("category",), ("source",), ("low",), ()], "category", "source", "low").agg(F.grouping_id("category", "source", "low").alias("g"), F.count("*").alias("n"))
    panel = F.create_map(*[F.lit(x) for x in (3, "category", 5, "source", 6, "low confidence", 7, "claims")])[F.col("g")]
    said = counted.where("g <> 6 or low").select(panel.alias("panel"), F.coalesce("category", "source", F.lit("")).alias("key"), "n", F.lit(None).cast(RAW).alias("total_raw"), F.lit(None).cast("long").alias("first_ts"), F.lit(None).cast("long").alias("last_ts"))
    return money.unionByName(said)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files that hold a table, in whatever store."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.sum("length")).first()[0] or 0
