"""Screening of deposits and ordered first-match policies."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import cut
from .graph import backward_walk
from .labels import merged
from .sequences import probes
from .store import sides

#: Fixed: categories at which a walk ends, as what lies behind them is pooled with other people's money.
TERMINAL = ("cex", "dex", "bridge", "mixer", "service")
EXPOSURE = "struct<node:string,hop:int,share:double,category:string,confidence:int,role:string,sources:array<string>>"
GAP = "struct<node:string,stopped:string>"
#: Names of the behavioural signals.
SIGNALS = ("fresh_address", "consolidation", "probing", "impersonation")
_SPLIT = "\x01"


def _key(address: Column, chain: Column | None = None) -> Column:
    """An address on its chain: two chains' histories of one address never mix. Null where the address is."""
    return F.concat(F.col("chain") if chain is None else chain, F.lit(_SPLIT), address)


def _chain_and_address(key: str) -> list[Column]:
    return [F.split_part(key, F.lit(_SPLIT), F.lit(1)).alias("chain"), F.split_part(key, F.lit(_SPLIT), F.lit(2)).alias("address")]


def dominant_assets(edges_in: DataFrame, decimals: DataFrame | None = None) -> DataFrame:
    """(chain, address, asset): the asset in which an address took in the largest quantity in display units; the least
    name at a tie. decimals: (asset, decimals), 0 where unknown."""
    rows = edges_in.where("total_raw > 0").groupBy("chain", "subject", F.coalesce("asset", F.lit("")).alias("asset")).agg(F.sum("total_raw").cast("double").alias("raw"))
    if decimals is not None:
        rows = rows.join(decimals.select(F.coalesce("asset", F.lit("")).alias("asset"), "decimals"), "asset", "left")
        rows = rows.withColumn("raw", F.col("raw") / F.pow(F.lit(10.0), F.coalesce("decimals", F.lit(0))))
    order = Window.partitionBy("chain", "subject").orderBy(F.desc("raw"), "asset")
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").select("chain", F.col("subject").alias("address"), F.when(F.col("asset") != "", F.col("asset")).alias("asset"))


def claims_by_chain(claims: DataFrame, chains: DataFrame) -> DataFrame:
    """Claims with `address` on its chain: a claim without a chain holds on all of them."""
    named = claims.where("chain is not null").unionByName(claims.where("chain is null").drop("chain").crossJoin(F.broadcast(chains.select("chain"))))  # chains: a few names
    return named.withColumn("address", _key(F.col("address")))


def screen(edges_in: DataFrame, claims: DataFrame, subjects: DataFrame, signals: DataFrame | None = None, expanded: DataFrame | None = None, hops: int = 4, service_degree: int = 40, roles: DataFrame | None = None) -> DataFrame:
    """One row per subject (chain, address, asset): exposures (labelled addresses that its money came through, each with
    the sources that say so), the behavioural signals, and the gaps: addresses of which nothing is known and at which a
    walk ends (a service, one never followed, or the hop limit). A screen without gaps is complete. All is taken by chain.
    signals: (chain, address, signals); expanded: (chain, address); roles: (chain, address, role)."""
    chains = cut(edges_in.select("chain").distinct(), "chains")
    keyed = edges_in.withColumns({c: _key(F.col(c)) for c in ("subject", "counterparty")})
    said = cut(claims_by_chain(claims, chains), "claims-by-chain")
    best = merged(said).select(F.col("address").alias("node"), "category", "confidence")
    sources = said.join(best.select(F.col("node").alias("address"), "category"), ["address", "category"]).groupBy(F.col("address").alias("node")).agg(F.array_sort(F.collect_set("source")).alias("sources"))
    terminal = best.where(F.col("category").isin(*TERMINAL)).select(F.col("node").alias("address"))
    followed = None if expanded is None else expanded.select(_key(F.col("address")).alias("address"))
    roots = subjects.select(_key(F.col("address")).alias("address"), "asset")
    reached = backward_walk(keyed, roots, hops, service_degree, terminal=terminal, expanded=followed)
    reached = reached.join(best.where("category <> 'unknown'"), "node", "left").join(sources, "node", "left")
    if roles is not None:
        reached = reached.join(roles.select(_key(F.col("address")).alias("node"), "role"), "node", "left")
    else:
        reached = reached.withColumn("role", F.lit(None).cast("string"))
    name = F.split_part("node", F.lit(_SPLIT), F.lit(2)).alias("node")
    item = F.struct(name, "hop", "share", "category", "confidence", "role", "sources")
    gap = F.when(F.col("category").isNull() & F.col("stopped").isNotNull(), F.struct(name, "stopped"))
    found = reached.groupBy("root").agg(F.array_sort(F.collect_list(F.when(F.col("category").isNotNull(), item))).alias("exposures"), F.array_sort(F.collect_list(gap)).alias("gaps"))
    got = roots.select("address").join(found, F.col("address") == F.col("root"), "left").select(*_chain_and_address("address"), "exposures", "gaps")
    if signals is not None:
        got = got.join(signals.select("chain", "address", "signals"), ["chain", "address"], "left")
    else:
        got = got.withColumn("signals", F.lit(None).cast("array<string>"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    got = got.select("chain", "address", none("exposures", EXPOSURE).alias("exposures"), none("signals", "string").alias("signals"), none("gaps", GAP).alias("gaps"))
    return got.withColumns({"n_signals": F.size("signals"), "complete": F.size("gaps") == 0})


def properties(screens: DataFrame) -> DataFrame:
    """What a screen says at a glance: complete; unattributed (signals, but no exposure); clean (complete, no exposure,
    no signal); the exposures' shares together, at most 1."""
    none = F.size("exposures") == 0
    total = F.least(F.lit(1.0), F.aggregate("exposures", F.lit(0.0), lambda acc, x: acc + x["share"]))
    return screens.select("chain", "address", "complete", (none & (F.col("n_signals") > 0)).alias("unattributed"), (F.col("complete") & none & (F.col("n_signals") == 0)).alias("clean"), F.round(total, 9).alias("total_share"))


def shape_signals(ledger: DataFrame, forged: DataFrame | Column | None = None, few: int = 20) -> DataFrame:
    """What an address's rows on a chain alone say: fresh (in and out, hardly used), consolidation (many payments in, few
    out), probing (either end of a probe), impersonation (a forged asset touches it; forged: (chain, asset), or what holds
    for forged transfers where one asset has both kinds), the names of those that hold, and how many they are."""
    rows = ledger.withColumns({"sender": _key(F.col("sender")), "recipient": _key(F.col("recipient"))})
    moves = sides(rows)
    counts = moves.groupBy("address").agg(F.count("*").alias("n"), F.count_if("outgoing").alias("outs"), F.count_if(~F.col("outgoing")).alias("ins"))
    ends = probes(rows)
    ends = ends.select(F.col("sender").alias("address")).union(ends.select("recipient")).distinct().withColumn("probing", F.lit(True))
    got = counts.join(ends, "address", "left")
    if forged is not None:
        touched = moves.where(forged) if isinstance(forged, Column) else moves.join(forged.select("chain", "asset").distinct(), ["chain", "asset"], "left_semi")
        hit = touched.select("address").distinct().withColumn("impersonation", F.lit(True))
        got = got.join(hit, "address", "left")
    else:
        got = got.withColumn("impersonation", F.lit(False))
    got = got.select(*_chain_and_address("address"), "n", ((F.col("ins") > 0) & (F.col("outs") > 0) & (F.col("n") <= few)).alias("fresh_address"), ((F.col("ins") >= 5) & (F.col("outs") <= 2)).alias("consolidation"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("probing", "impersonation")])
    held = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in SIGNALS]))
    return got.withColumn("signals", held).withColumn("n_signals", F.size("signals"))


@dataclass(frozen=True)
class Rule:
    """First match wins. Conditions on an exposure hold for one exposure together; only a confidence is no condition."""

    name: str
    action: str
    categories: tuple[str, ...] = ()
    role: str | None = None
    max_hops: int | None = None
    min_share: float | None = None
    min_confidence: int | None = None
    signals: bool = False
    unattributed: bool = False
    incomplete: bool = False

    def on_exposure(self, x: Column) -> Column | None:
        tests = []
        if self.categories:
            tests.append(x["category"].isin(*self.categories))
        if self.role is not None:
            tests.append(x["role"] == self.role)
        if self.max_hops is not None:
            tests.append(x["hop"] <= self.max_hops)
        if self.min_share is not None:
            tests.append(x["share"] >= self.min_share)
        if not tests:
            return None
        if self.min_confidence is not None:
            tests.append(x["confidence"] >= self.min_confidence)
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    def holds(self, roles: bool) -> Column:
        """Over columns exposures (array of structs, with roles or without), n_signals, complete."""
        out = F.lit(False)
        if (self.categories or self.role or self.max_hops is not None or self.min_share is not None) and (roles or not self.role):
            out = out | F.exists("exposures", lambda x: self.on_exposure(x))
        if self.signals:
            out = out | (F.col("n_signals") > 0)
        if self.unattributed:
            out = out | ((F.col("n_signals") > 0) & (F.size("exposures") == 0))
        if self.incomplete:
            out = out | ~F.col("complete")
        return out


def rule_of(record: dict) -> Rule:
    """A rule out of a configuration file's record; a condition that isn't known is refused, as ignoring it would widen
    the rule."""
    unknown = set(record) - {f.name for f in fields(Rule)}
    if unknown:
        raise ValueError(f"unknown conditions: {', '.join(sorted(unknown))}")
    return Rule(**{k: tuple(v) if k == "categories" else v for k, v in record.items()})


#: Fixed: the starter policy's rules in order.
STARTER = (
    Rule("sanctioned-direct", "reject", ("sanctioned",), max_hops=0),
    Rule("sanctioned-indirect", "escalate", ("sanctioned",)),
    Rule("attacker-role", "escalate", role="attacker"),
    Rule("mixer-material", "enhanced_kyc", ("mixer",), min_share=0.05),
    Rule("illicit-well-sourced", "escalate", ("illicit", "scam"), min_confidence=3),
    Rule("incomplete", "hold", incomplete=True),
    Rule("shape-only", "hold", unattributed=True),
    Rule("exchange-only", "allow", ("cex",), max_hops=0),
)


def _decision(screens: DataFrame, rules: tuple[Rule, ...], default: str) -> tuple[Column, Column]:
    """(rule, action) of a screen's columns, with floors: an incomplete screen is never allowed, and nothing irreversible
    happens without an exposure."""
    roles = "role" in screens.schema["exposures"].dataType.elementType.names
    rule = F.coalesce(*[F.when(r.holds(roles), F.lit(r.name)) for r in rules], F.lit("default"))
    said = F.coalesce(*[F.when(r.holds(roles), F.lit(r.action)) for r in rules], F.lit(default))
    return rule, F.when((said == "allow") & ~F.col("complete"), "hold").when((said == "reject") & (F.size("exposures") == 0), "escalate").otherwise(said)


def decide(screens: DataFrame, rules: tuple[Rule, ...] = STARTER, default: str = "hold") -> DataFrame:
    """The first rule that holds, with the floors of `_decision`."""
    rule, action = _decision(screens, rules, default)
    return screens.select(*[c for c in ("chain", "address") if c in screens.columns], rule.alias("rule"), action.alias("action"))


def counterfactuals(screens: DataFrame, rules: tuple[Rule, ...] = STARTER, default: str = "hold") -> DataFrame:
    """(chain, address, kind, without, was, becomes): what the decision would be without one source (exposures that rest on
    it alone go) or without one signal, where it differs. One explode makes all variants; the policy runs over them once."""
    sources = F.array_distinct(F.flatten(F.transform("exposures", lambda x: x["sources"])))
    one = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("what"))
    rows = screens.withColumn("was", _decision(screens, rules, default)[1]).withColumn("_w", F.explode(F.concat(F.transform(sources, one("source")), F.transform("signals", one("signal")))))
    source, signal = F.col("_w.kind") == "source", F.col("_w.kind") == "signal"
    left = F.filter("exposures", lambda x: ~((F.size(x["sources"]) == 1) & (x["sources"][0] == F.col("_w.what"))))
    rows = rows.withColumns({"exposures": F.when(source, left).otherwise(F.col("exposures")), "signals": F.when(signal, F.array_remove("signals", F.col("_w.what"))).otherwise(F.col("signals"))})
    rows = rows.withColumn("n_signals", F.size("signals"))
    rows = rows.withColumn("becomes", _decision(rows, rules, default)[1]).where("was <> becomes")
    return rows.select("chain", "address", "_w.kind", F.col("_w.what").alias("without"), "was", "becomes")
