"""Graphs of transfers: hubs, bounded walks, time-respecting routes, layers, components, backward screening.

Loops over levels run on the driver; each level is a join whose result is written to the checkpoint folder, so
lineage stays short and a lost executor costs one level at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import cut, release
from .store import RAW, sides


def degrees(ledger: DataFrame) -> DataFrame:
    """Distinct counterparties of each address in both directions; a payment to oneself counts oneself."""
    return sides(ledger).where("other is not null").groupBy("address").agg(F.count_distinct("other").alias("degree"))


def hubs(ledger: DataFrame, degree: int = 25) -> DataFrame:
    return degrees(ledger).where(F.col("degree") > degree)


def service_shaped(ledger: DataFrame, degree: int = 40) -> DataFrame:
    """Addresses with so many distinct peers, themselves not counted."""
    return sides(ledger).where("other is not null and other <> address").groupBy("address").agg(F.count_distinct("other").alias("peers")).where(F.col("peers") >= degree)


def walk(edges: DataFrame, seeds: DataFrame, depth: int = 2, per_node: int = 10) -> DataFrame:
    """Bounded breadth-first walk: (node, level, expanded). Each node shows its strongest edges only; `truncated`
    says where that cut something off."""
    ranked = edges.groupBy("subject", "counterparty").agg(F.sum("n").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("n"), "counterparty")))
    seen = cut(seeds.select(F.col("address").alias("node"), F.lit(0).alias("level")).distinct())
    for level in range(1, depth + 1):
        step = seen.where(F.col("level") == level - 1).join(ranked.where(F.col("r") <= per_node), F.col("node") == F.col("subject")).select(F.col("counterparty").alias("node")).distinct()
        fresh = step.join(seen, "node", "left_anti").withColumn("level", F.lit(level))
        old, seen = seen, cut(seen.unionByName(fresh))
        release(old)
    over = ranked.groupBy(F.col("subject").alias("node")).agg((F.max("r") > per_node).alias("truncated"))
    return seen.join(over, "node", "left").select("node", "level", (F.col("level") < depth).alias("expanded"), F.coalesce("truncated", F.lit(False)).alias("truncated"))


def latest_departures(rows: DataFrame, target: str, hops: int) -> list[DataFrame]:
    """For 1 to `hops` payments left: (node, latest), the last moment at which a payment may leave a node so that later ones
    still reach the target in time. Stored."""
    tables = [cut(rows.where(F.col("recipient") == target).groupBy(F.col("sender").alias("node")).agg(F.max("ts").alias("latest")), "departures")]
    for _ in range(hops - 1):
        step = rows.join(tables[-1], (F.col("recipient") == F.col("node")) & (F.col("ts") <= F.col("latest")))
        both = step.select(F.col("sender").alias("node"), F.col("ts").alias("latest")).unionByName(tables[-1])
        tables.append(cut(both.groupBy("node").agg(F.max("latest").alias("latest")), "departures"))
    return tables


def routes(ledger: DataFrame, source: str, target: str, max_hops: int = 5, max_routes: int = 20, hub_degree: int = 25, allow_hubs: bool = False) -> DataFrame:
    """Simple paths whose payments don't go back in time, best first: fewer hops, then the larger smallest amount.

    Hubs don't pass anything on. A payment is followed only if from its recipient the target can still be reached, in time
    and with the hops left: the table of latest departures says so exactly, but for paths that cross themselves. Since fewer
    hops are better, levels end as soon as more than max_routes are found; the answer is the best max_routes, with
    `truncated` set if there were more."""
    rows = ledger.where("sender is not null and recipient is not null and sender <> recipient and ts is not null").select("sender", "recipient", "ts", "amount_raw", "tx_hash")
    if not allow_hubs:
        blocked = hubs(ledger, hub_degree).where(~F.col("address").isin(source, target)).select("address")
        rows = rows.join(blocked, rows["sender"] == blocked["address"], "left_anti")
    rows = cut(rows, "payments")
    left = latest_departures(rows, target, max_hops - 1) if max_hops > 1 else []
    paths = rows.where(F.col("sender") == source).select(F.array("sender", "recipient").alias("nodes"), F.array("tx_hash").alias("txs"), F.col("recipient").alias("end"), F.col("ts").alias("at"), F.col("amount_raw").alias("carries"))
    found = None
    for hop in range(1, max_hops + 1):
        if hop < max_hops:  # what goes on is cut down before it is written
            on = paths.where(F.col("end") != target).join(left[max_hops - hop - 1], F.col("end") == F.col("node")).where("at <= latest").drop("node", "latest")
            paths = cut(on.unionByName(paths.where(F.col("end") == target)), "paths")
        done = paths.where(F.col("end") == target)
        found = done if found is None else found.unionByName(done)
        if hop == max_hops or found.limit(max_routes + 1).count() > max_routes:
            break
        step = paths.where(F.col("end") != target).join(rows, (F.col("end") == F.col("sender")) & (F.col("ts") >= F.col("at"))).where(~F.array_contains("nodes", F.col("recipient")))
        paths = step.select(F.array_append("nodes", F.col("recipient")).alias("nodes"), F.array_append("txs", F.col("tx_hash")).alias("txs"), F.col("recipient").alias("end"), F.col("ts").alias("at"), F.least("carries", "amount_raw").alias("carries"))
    best = found.select("txs", "nodes", F.size("txs").alias("hops"), "carries").orderBy("hops", F.desc("carries"), "txs").limit(max_routes + 1)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy("hops", F.desc("carries"), "txs")))
    return ranked.withColumn("truncated", F.max("rank").over(Window.partitionBy(F.lit(1))) > max_routes).where(F.col("rank") <= max_routes).select("rank", "hops", "carries", F.concat_ws(">", "nodes").alias("path"), "truncated")


def span_routes(spans: DataFrame, source: str, target: str, max_hops: int = 3, most: int = 40) -> DataFrame:
    """Simple paths over aggregated edges (source, target, first, last): an edge can be used if its last payment isn't
    before the arrival, which it moves to its first payment if that is later. The best `most` possible paths by hops and
    names, each with how many paths there are by names alone and how many of those time rules out."""
    e = cut(spans.where("source <> target").groupBy("source", "target").agg(F.min("first").alias("first"), F.max("last").alias("last")))
    near = [cut(e.where(F.col("target") == target).select(F.col("source").alias("node")).distinct())]
    for _ in range(max_hops - 2):
        near.append(cut(e.join(near[-1], F.col("target") == F.col("node"), "left_semi").select(F.col("source").alias("node")).union(near[-1]).distinct()))
    paths = e.where(F.col("source") == source).select(F.array("source", "target").alias("nodes"), F.col("target").alias("end"), F.col("first").alias("at"), F.lit(True).alias("possible"))
    found = None
    for hop in range(1, max_hops + 1):
        done = paths.where(F.col("end") == target)
        found = done if found is None else found.unionByName(done)
        if hop < max_hops:
            alive = paths.where(F.col("end") != target).join(near[max_hops - hop - 1], F.col("end") == F.col("node"), "left_semi")
            step = alive.join(e, F.col("end") == F.col("source")).where(~F.array_contains("nodes", F.col("target")))
            paths = cut(step.select(F.array_append("nodes", F.col("target")).alias("nodes"), F.col("target").alias("end"), F.greatest("at", "first").alias("at"), (F.col("possible") & (F.col("last") >= F.col("at"))).alias("possible")))
    found = cut(found.select((F.size("nodes") - 1).alias("hops"), F.concat_ws(">", "nodes").alias("path"), "at", "possible"))
    counts = found.agg(F.count("*").alias("paths"), F.count_if(~F.col("possible")).alias("impossible"))
    best = found.where("possible").orderBy("hops", "path").limit(most)
    return best.crossJoin(F.broadcast(counts)).select("hops", "path", F.col("at").alias("arrival"), "paths", "impossible")  # counts is one row


def layers(edges: DataFrame, seeds: DataFrame, most: int = 6) -> DataFrame:
    """Signed depth: levels against the payments count down, levels along them count up; nodes that only the second
    walk could reach through nodes of the first stay out of it."""
    pairs = cut(edges.select("subject", "counterparty").distinct())
    seen = cut(seeds.select(F.col("address").alias("node"), F.lit(0).alias("layer")).distinct())
    for sign, here, there in ((-1, "counterparty", "subject"), (1, "subject", "counterparty")):
        for k in range(1, most + 1):
            at = seen.where(F.col("layer") == sign * (k - 1))
            fresh = at.join(pairs, F.col("node") == F.col(here)).select(F.col(there).alias("node")).distinct().join(seen, "node", "left_anti").withColumn("layer", F.lit(sign * k))
            old, seen = seen, cut(seen.unionByName(fresh))
            release(old)
    release(pairs)
    return seen


def _tangled(edges: DataFrame) -> bool:
    """Whether some node has two parents, or a parent and children."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").limit(1).count() > 0


def stars(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with v < u, distinct, as one star for each component: every other node u with the least node v. Alternating
    stars (Kiveris and others, 2014): rounds grow with the logarithm of the graph, rows stay below the number of edges.
    Its joins are merge joins by hint: small tables then don't pile up as broadcasts on the driver."""
    edges = cut(edges, "edges")
    while _tangled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        joined = large.join(large.groupBy("u").agg(F.min("v").alias("m")).hint("merge"), "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        old, edges = edges, cut(small, "edges")
        release(old)
    return edges


def connected(pairs: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph (a, b): the least node reachable."""
    e = stars(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    alone = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).where("node is not null").distinct()
    return alone.join(e.select(F.col("u").alias("node"), F.col("v").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))


def co_spend(inputs: DataFrame, outputs: DataFrame, equal_outputs: int = 5, min_inputs: int = 5) -> DataFrame:
    """Clusters of addresses that sign together; joint payments of strangers (coinjoin shape) don't connect them.
    Each transaction is a star around its least address, so a large one costs its inputs once."""
    shape = coinjoins(inputs, outputs, equal_outputs, min_inputs).where("coinjoin").select("txid")
    own = inputs.join(shape, "txid", "left_anti")
    star = own.join(own.groupBy("txid").agg(F.min("address").alias("b")), "txid").select(F.col("address").alias("a"), "b")
    return connected(star)


def coinjoins(inputs: DataFrame, outputs: DataFrame, equal_outputs: int = 5, min_inputs: int = 5) -> DataFrame:
    n = inputs.groupBy("txid").agg(F.count("*").alias("inputs"))
    same = outputs.groupBy("txid", "amount").agg(F.count("*").alias("c")).groupBy("txid").agg(F.max("c").alias("equal"))
    return n.join(same, "txid", "left").select("txid", "inputs", F.coalesce("equal", F.lit(0)).cast("long").alias("equal"), ((F.col("inputs") >= min_inputs) & (F.coalesce("equal", F.lit(0)) >= equal_outputs)).alias("coinjoin"))


def change_scores(inputs: DataFrame, outputs: DataFrame, tx_counts: DataFrame | None = None) -> DataFrame:
    """Which output is change, by fixed weights: +5 pays back an input, -1 a hardly used recipient, -2 a round amount,
    +2 the inputs' script type, +2 the single largest output; a single output is change."""
    # outputs, inputs and first uses of addresses are dealt by transaction once; what follows are windows inside transactions
    rows = outputs.select("txid", "idx", "address", "amount", "script", F.lit(0).alias("_mark"))
    rows = rows.unionByName(inputs.where("txid is not null and address is not null").select("txid", "address", F.lit(1).alias("_mark")), allowMissingColumns=True)
    if tx_counts is None:  # an address of one transaction is hardly used there
        use = outputs.where("address is not null").groupBy("address").agg(F.min("txid").alias("txid"), F.max("txid").alias("_last")).where("txid = _last").select("txid", "address")
    else:
        use = outputs.join(tx_counts.where("seen between 0 and 1"), "address", "left_semi").select("txid", "address")
    rows = rows.unionByName(use.withColumn("_mark", F.lit(2)), allowMissingColumns=True).repartition("txid")
    pair, like, w = Window.partitionBy("txid", "address"), Window.partitionBy("txid", "script"), Window.partitionBy("txid")
    rows = rows.withColumns({"_in": F.max(F.col("_mark") == 1).over(pair), "_rare": F.max(F.col("_mark") == 2).over(pair)}).where("_mark = 0")
    rows = rows.withColumn("_c", F.count("*").over(like)).withColumns({"usual": F.max(F.struct("_c", "script")).over(w)["script"], "top": F.max("amount").over(w), "n_out": F.count("*").over(w)})
    rows = rows.withColumn("n_top", F.sum((F.col("amount") == F.col("top")).cast("int")).over(w))
    score = (
        F.when(F.col("_in"), 5).otherwise(0) + F.when(F.col("_rare"), -1).otherwise(0) + F.when((F.col("amount") % 1000 == 0) & (F.col("amount") >= 1000), -2).otherwise(0)
        + F.when(F.col("script") == F.col("usual"), 2).otherwise(0) + F.when((F.col("amount") == F.col("top")) & (F.col("n_top") == 1), 2).otherwise(0)
    )
    rows = rows.withColumn("score", score)
    rows = rows.withColumn("best", F.max("score").over(w)).withColumn("n_best", F.sum((F.col("score") == F.col("best")).cast("int")).over(w))
    change = (F.col("n_out") == 1) | ((F.col("score") == F.col("best")) & (F.col("n_best") == 1) & (F.col("score") > 0))
    return rows.select("txid", "idx", "address", "amount", F.col("score").cast("int").alias("score"), change.alias("is_change"))


def peers(edges_in: DataFrame) -> DataFrame:
    """(node, peers): distinct counterparties of each address in either direction, itself not counted."""
    both = edges_in.select(F.col("subject").alias("node"), F.col("counterparty").alias("other")).unionByName(edges_in.select(F.col("counterparty").alias("node"), F.col("subject").alias("other")))
    return both.where("node <> other").groupBy("node").agg(F.count_distinct("other").alias("peers"))


def backward_walk(edges_in: DataFrame, subjects: DataFrame, hops: int = 4, service_degree: int = 40, dust: float = 1e-6, terminal: DataFrame | None = None, expanded: DataFrame | None = None) -> DataFrame:
    """Where the money of each subject came from, in one asset: (root, node, hop, share, stopped).

    A subject's own funders are at hop 0. Shares multiply along edges (the parent's share times the edge's part of what
    the parent took in, without dust); an address counts at its first reach, by way of the parent with the largest share
    (the least name at a tie). `stopped` says why a walk ends there: "service" (many peers, or listed in terminal),
    "unreachable" (not in expanded, where that is given), "hop_limit", or null: it was followed.
    edges_in: subject receives from counterparty; subjects: (address, asset)."""
    positive = edges_in.where("total_raw > 0 and subject <> counterparty").groupBy("subject", "counterparty", F.coalesce("asset", F.lit("")).alias("asset")).agg(F.sum("total_raw").cast(RAW).alias("raw"))
    most = Window.partitionBy("subject", "asset")
    kept = positive.withColumn("most", F.max("raw").over(most)).where(F.col("raw") >= F.floor(F.col("most") * F.lit(dust).cast("decimal(10,8)")))
    part = kept.withColumn("part", F.col("raw").cast("double") / F.sum("raw").over(most).cast("double"))
    part = cut(part.select(F.col("subject").alias("at"), "counterparty", F.col("asset").alias("of"), "part"))
    stops = peers(edges_in).where(F.col("peers") >= service_degree).select("node")
    if terminal is not None:
        stops = stops.unionByName(terminal.select(F.col("address").alias("node")))
    stops = cut(stops.distinct().withColumn("service", F.lit(True)))
    known = None if expanded is None else cut(expanded.select(F.col("address").alias("node")).distinct().withColumn("known", F.lit(True)))
    roots = subjects.select(F.col("address").alias("root"), F.coalesce("asset", F.lit("")).alias("asset"))
    front = roots.select("root", "asset", F.col("root").alias("node"), F.lit(1.0).alias("share"))
    seen = cut(roots.select("root", F.col("root").alias("node"), F.lit(-1).alias("hop"), F.lit(1.0).alias("share"), F.lit(None).cast("string").alias("stopped")))
    last_fresh = None
    for hop in range(hops):
        reach = front.join(part, (F.col("node") == F.col("at")) & (F.col("asset") == F.col("of")))
        best = F.min_by(F.col("share") * F.col("part"), F.struct((-F.col("share")).alias("s"), F.col("node")))
        fresh = reach.groupBy("root", "asset", F.col("counterparty").alias("to")).agg(best.alias("share")).withColumnRenamed("to", "node")
        fresh = fresh.join(seen.select("root", "node"), ["root", "node"], "left_anti").join(stops, "node", "left")
        unknown = F.lit(False)
        if known is not None:
            fresh = fresh.join(known, "node", "left")
            unknown = F.col("known").isNull()
        last = F.lit("hop_limit" if hop == hops - 1 else None).cast("string")
        fresh = cut(fresh.select("root", "asset", "node", F.least(F.lit(1.0), "share").alias("share"), F.when(F.col("service"), "service").when(unknown, "unreachable").otherwise(last).alias("stopped")))
        old, seen = seen, cut(seen.unionByName(fresh.select("root", "node", F.lit(hop).alias("hop"), "share", "stopped")))
        release(old, *([last_fresh] if last_fresh is not None else []))
        front, last_fresh = fresh.where("stopped is null").drop("stopped"), fresh
    release(part, stops, *[x for x in (known, last_fresh) if x is not None])
    return seen.where("hop >= 0")
