"""Ordered sequences: runs, probing, trails, activity in time, passes through relays, last events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import RAW, sides

PAIR = ("sender", "recipient", "asset", "decimals", "symbol")


def longest_runs(rows: DataFrame, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """Per group the earliest longest run of strictly rising amounts in (block, log_index, tx_hash) order."""
    w = Window.partitionBy(*keys).orderBy("block", "log_index", "tx_hash")
    falls = F.when(F.col("amount_raw") > F.lag("amount_raw").over(w), 0).otherwise(1)
    marked = rows.withColumn("pos", F.row_number().over(w)).withColumn("falls", falls)
    marked = marked.withColumn("island", F.sum("falls").over(w))
    runs = marked.groupBy(*keys, "island").agg(F.count("*").alias("steps"), F.min("pos").alias("start"), F.min("amount_raw").alias("low"), F.max("amount_raw").alias("high"))
    best = Window.partitionBy(*keys).orderBy(F.desc("steps"), "start")
    return runs.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r", "island")


def probes(rows: DataFrame, min_steps: int = 5, min_growth: int = 8, min_ratio: int = 100) -> DataFrame:
    """Escalations (a long enough rising run that grows enough), else a test payment followed by a commitment."""
    if min_steps < 3:
        raise ValueError("fewer than three steps are no pattern")
    keyed = rows.where("sender is not null and recipient is not null and amount_raw > 0")
    runs = longest_runs(keyed)
    w = Window.partitionBy(*PAIR).orderBy("block", "log_index", "tx_hash")
    heads = keyed.withColumn("pos", F.row_number().over(w)).groupBy(*PAIR).agg(F.min(F.when(F.col("pos") == 1, F.col("amount_raw"))).alias("opening"), F.max(F.when(F.col("pos") > 1, F.col("amount_raw"))).alias("later"), F.count("*").alias("n"))
    a, b = runs.alias("a"), heads.alias("b")
    got = a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in PAIR]).select("a.*", "b.opening", "b.later", "b.n")
    rises = (F.col("steps") >= min_steps) & (F.col("high") >= F.col("low") * min_growth)
    tests = F.col("later") >= F.col("opening") * min_ratio
    got = got.withColumn("kind", F.when(rises, "escalation").when(tests, "test_then_commit")).where("kind is not null")
    got = got.select("sender", "recipient", "asset", "symbol", "kind", F.when(F.col("kind") == "escalation", F.col("steps")).otherwise(F.lit(2)).cast("long").alias("steps"), F.when(F.col("kind") == "escalation", F.col("low")).otherwise(F.col("opening")).alias("from_raw"), F.when(F.col("kind") == "escalation", F.col("high")).otherwise(F.col("later")).alias("to_raw"))
    # a shape is medium evidence at most: where chance (1 in steps factorial) hardly makes it, or it reaches far
    long = (F.col("kind") == "escalation") & (F.col("steps") >= min_steps + 2)
    far = F.col("to_raw") >= F.col("from_raw") * min_ratio
    return got.withColumn("confidence", F.when(long | (F.col("steps") >= 5) | far, 2).otherwise(1))


def trail(ledger: DataFrame, share: float = 1e-6) -> DataFrame:
    """All movements of each address in order: position, direction, whether minor against the largest of its asset.
    A payment to oneself is one outgoing movement."""
    moves = sides(ledger).where("amount_raw > 0").where(F.col("outgoing") | ~F.col("address").eqNullSafe(F.col("other")))
    most = F.max("amount_raw").over(Window.partitionBy("address", "asset"))
    w = Window.partitionBy("address").orderBy("block", "tx_hash", F.desc("outgoing"))
    return moves.withColumn("minor", F.col("amount_raw") < F.floor(most * F.lit(share).cast("decimal(10,8)"))).withColumn("seq", F.row_number().over(w)).select("address", "seq", "outgoing", "other", "asset", "amount_raw", "minor")


def activity(ledger: DataFrame) -> DataFrame:
    """Per sender: samples, peak hour (the lowest at ties), weekend share, circular mean hour and concentration, and
    the variation of the gaps between payments (needs two gaps)."""
    dated = ledger.where("sender is not null and ts is not null").withColumn("hour", F.floor(F.pmod(F.col("ts"), F.lit(86400)) / 3600).cast("int")).withColumn("weekday", F.pmod(F.floor(F.col("ts") / 86400) + 3, F.lit(7)).cast("int"))
    w = Window.partitionBy("sender").orderBy("ts")
    gap = F.col("ts") - F.lag("ts").over(w)
    rows = dated.withColumn("gap", F.when(gap > 0, gap))
    angle = F.col("hour") * F.lit(3.141592653589793) / 12
    base = rows.groupBy("sender").agg(
        F.count("*").alias("samples"), F.avg((F.col("weekday") >= 5).cast("double")).alias("weekend"),
        F.avg(F.cos(angle)).alias("x"), F.avg(F.sin(angle)).alias("y"),
        F.when(F.count("gap") >= 2, F.stddev_pop("gap") / F.avg("gap")).alias("gap_cv"),
    )
    hours = rows.groupBy("sender", "hour").agg(F.count("*").alias("n"))
    peak = hours.groupBy("sender").agg(F.max(F.struct("n", (-F.col("hour")).alias("h"))).alias("p")).select("sender", (-F.col("p.h")).alias("peak_hour"))
    mean = F.pmod(F.degrees(F.atan2("y", "x")) / 15 + 24, F.lit(24.0))
    return base.join(peak, "sender").select("sender", "samples", "peak_hour", F.round("weekend", 6).alias("weekend_ratio"), F.round(mean, 6).alias("mean_hour"), F.round(F.hypot("x", "y"), 6).alias("concentration"), F.round("gap_cv", 6).alias("gap_cv"))


def gaps(ledger: DataFrame) -> DataFrame:
    """Per sender the positive gaps between its payments in time: how many, the smallest, the largest, their sum."""
    w = Window.partitionBy("sender").orderBy("ts")
    rows = ledger.where("sender is not null and ts is not null").select("sender", (F.col("ts") - F.lag("ts").over(w)).alias("gap")).where("gap > 0")
    return rows.groupBy("sender").agg(F.count("*").alias("gaps"), F.min("gap").alias("least"), F.max("gap").alias("most"), F.sum("gap").alias("total"))


def completeness(sent: DataFrame, accounts: DataFrame) -> DataFrame:
    """(address, complete): whether as many payments were seen as the account's nonce counts; null where it is unknown."""
    seen = sent.groupBy(F.col("sender").alias("address")).agg(F.count("*").alias("seen"))
    return accounts.join(seen, "address", "left").select("address", (F.col("nonce") == F.coalesce("seen", F.lit(0))).alias("complete"))


def quiet_windows(ledger: DataFrame) -> DataFrame:
    """Per sender the longest circular stretch of hours at or below half the mean, of 3 to 23 hours."""
    hours = ledger.where("sender is not null and ts is not null").groupBy("sender", F.floor(F.pmod(F.col("ts"), F.lit(86400)) / 3600).cast("int").alias("hour")).agg(F.count("*").alias("n"))
    table = hours.groupBy("sender").agg(F.map_from_entries(F.collect_list(F.struct("hour", "n"))).alias("m"), F.sum("n").alias("total"))
    grid = table.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(47)))).withColumn("quiet", F.coalesce(F.element_at("m", (F.col("pos") % 24).cast("int")), F.lit(0)) * 48 <= F.col("total"))
    w = Window.partitionBy("sender").orderBy("pos")
    grid = grid.withColumn("island", F.col("pos") - F.sum(F.col("quiet").cast("int")).over(w)).where("quiet")
    runs = grid.groupBy("sender", "island").agg(F.count("*").alias("hours"), F.min("pos").alias("start"))
    best = Window.partitionBy("sender").orderBy(F.desc("hours"), "start")
    return runs.withColumn("_r", F.row_number().over(best)).where("_r = 1 and hours between 3 and 23").select("sender", (F.col("start") % 24).cast("int").alias("quiet_from"), F.col("hours").alias("quiet_hours"))


def pass_throughs(ledger: DataFrame, max_residue_bps: int = 100) -> DataFrame:
    """Addresses that took one payment of an asset and sent nearly all of it on, and did nothing else with it."""
    moves = sides(ledger)
    few = moves.groupBy("address", "asset").agg(F.count("*").alias("n"), F.count_if("outgoing").alias("outs"), F.max(F.when(~F.col("outgoing"), F.col("amount_raw"))).alias("raw_in"), F.max(F.when(F.col("outgoing"), F.col("amount_raw"))).alias("raw_out"), F.max(F.when(~F.col("outgoing"), F.struct("block", "log_index"))).alias("at_in"), F.max(F.when(F.col("outgoing"), F.struct("block", "log_index"))).alias("at_out"))
    few = few.where("n = 2 and outs = 1 and at_in < at_out and raw_in > 0 and raw_out <= raw_in")
    return few.where((F.col("raw_in") - F.col("raw_out")) * 10000 <= F.col("raw_in") * max_residue_bps).select("address", "asset", F.col("raw_in").cast(RAW).alias("raw_in"), F.col("raw_out").cast(RAW).alias("raw_out"))


def splits(distributions: DataFrame, min_appearances: int = 4, min_bps: int = 5, tolerance: float = 0.05) -> DataFrame:
    """Each recipient's share of its distributions in basis points: median, spread, and whether that is a fixed cut."""
    total = F.sum("amount_raw").over(Window.partitionBy("tx"))
    share = distributions.withColumn("bps", F.floor(F.col("amount_raw").cast("decimal(28,0)") * 10000 / total.cast("decimal(28,0)")).cast("long"))
    got = share.groupBy("recipient").agg(F.count("*").alias("appearances"), F.floor(F.median("bps")).cast("long").alias("median_bps"), (F.max("bps") - F.min("bps")).alias("spread_bps"))
    stable = (F.col("appearances") >= min_appearances) & (F.col("median_bps") >= min_bps) & (F.col("spread_bps") <= F.col("median_bps") * tolerance)
    return got.withColumn("stable", stable)


def ranked_hypotheses(scores: DataFrame, margin: float = 1.0) -> DataFrame:
    """Hypotheses of a subject by score; contested if the runner-up is within the margin."""
    w = Window.partitionBy("subject").orderBy(F.desc("score"), "hypothesis")
    return scores.withColumn("rank", F.row_number().over(w)).withColumn("contested", F.coalesce(F.col("score") - F.lead("score").over(w) < margin, F.lit(False)))


def last_status(events: DataFrame, key: str, order: str, status: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(status, order).alias("status"), F.count("*").alias("events"))
