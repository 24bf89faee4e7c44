"""Attribution claims: merging, disputes, coverage, imports with their conflicts, watches over labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import stamped

HIGH = 3
#: Fixed vocabularies: spellings in imported files and what they mean, and the headers that name each field.
CATEGORY_ALIASES = {
    "exchange": "cex", "cex": "cex", "centralized exchange": "cex", "dex": "dex", "decentralized exchange": "dex", "bridge": "bridge", "mixer": "mixer", "tumbler": "mixer",
    "sanctioned": "sanctioned", "sanction": "sanctioned", "ofac": "sanctioned", "sdn": "sanctioned", "illicit": "illicit", "scam": "illicit", "phishing": "illicit", "hack": "illicit", "exploit": "illicit",
    "token": "token", "contract": "contract", "service": "service",
}
CONFIDENCE_WORDS = {"certain": 4, "confirmed": 4, "high": 3, "medium": 2, "med": 2, "low": 1, "speculative": 0, "guess": 0, "unconfirmed": 0}
METHOD_WORDS = {"list": "list", "label": "label", "nametag": "label", "onchain": "onchain", "on-chain": "onchain", "heuristic": "heuristic", "inference": "inference", "inferred": "inference", "manual": "manual"}
COLUMNS = {
    "address": ("address", "addr", "wallet", "account", "entity_address"),
    "label": ("label", "name", "tag", "entity", "nametag", "description"),
    "category": ("category", "type", "kind", "entity_type", "class"),
    "confidence": ("confidence", "certainty", "score"),
    "chain": ("chain", "network", "chain_id", "blockchain"),
    "rationale": ("rationale", "reason", "note", "notes", "evidence", "comment"),
    "method": ("method", "how", "basis"),
    "observed_at": ("observed_at", "date", "timestamp", "seen", "first_seen"),
}


def applies(claim_chain: Column, chain: Column) -> Column:
    return claim_chain.isNull() | (claim_chain == chain)


def merged(claims: DataFrame) -> DataFrame:
    """Per address: the primary claim (sanctions first, then confidence, known categories, recency; ties by source and
    label), how many claims there are, and whether trusted claims dispute each other."""
    rank = F.struct(
        (F.col("category") == "sanctioned").alias("s"), F.col("confidence").alias("c"), (F.col("category") != "unknown").alias("k"),
        F.coalesce("observed_at", F.lit(0)).alias("o"), F.col("source").alias("src"), F.col("label").alias("lab"),
    )
    trusted = F.when((F.col("confidence") >= HIGH) & (F.col("category") != "sanctioned"), F.col("category"))
    got = claims.groupBy("address").agg(F.max_by(F.struct("label", "category", "confidence", "source"), rank).alias("p"), F.count("*").alias("n_claims"), (F.count_distinct(trusted) > 1).alias("disputed"))
    return got.select("address", "p.label", "p.category", "p.confidence", "p.source", "n_claims", "disputed")


def by_address(claims: DataFrame, address: str) -> DataFrame:
    return claims.where(F.col("address") == address).orderBy(F.desc("confidence"), "source", "label")


def labelled_transfers(ledger: DataFrame, claims: DataFrame) -> DataFrame:
    """Each transfer with the best label of its recipient among claims that apply to the chain. Claims are ranked before
    the joins, so equal transfers stay as many as they are."""
    best = F.max(F.struct("confidence", "source", "label", "category"))
    here = claims.where("chain is not null").groupBy(F.col("address").alias("recipient"), "chain").agg(best.alias("_here"))
    anywhere = claims.where("chain is null").groupBy(F.col("address").alias("recipient")).agg(best.alias("_any"))
    rows = ledger.join(here, ["recipient", "chain"], "left").join(anywhere, "recipient", "left").withColumn("_c", F.greatest("_here", "_any"))
    return rows.select("chain", "tx_hash", "recipient", F.col("_c.label").alias("label"), F.col("_c.category").alias("category"), F.col("_c.confidence").alias("confidence"))


def resolved(addresses: DataFrame, claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Per address what all consulted sources (source, failed) say together: the primary claim, how many claims, how many
    sources failed, and whether it is sanctioned: true if any says so, unknown (null) if one failed, else false. Only
    `false` clears an address."""
    used = claims.join(sources.where("not failed").select("source"), "source", "left_semi")
    best = merged(used).select("address", "label", "category", "confidence", "n_claims")
    listed = used.where("category = 'sanctioned'").select("address").distinct().withColumn("_listed", F.lit(True))
    asked = sources.agg(F.count("*").alias("consulted"), F.count_if("failed").alias("failed"))
    got = addresses.select("address").distinct().join(best, "address", "left").join(listed, "address", "left").crossJoin(F.broadcast(asked))  # asked is one row
    sanctioned = F.when(F.col("_listed"), True).when(F.col("failed") == 0, False)
    return got.select("address", "category", "confidence", F.coalesce("n_claims", F.lit(0)).alias("n_claims"), "consulted", "failed", sanctioned.alias("sanctioned"), (~F.coalesce(sanctioned, F.lit(True))).alias("cleared"))


def coverage(addresses: DataFrame, claims: DataFrame) -> DataFrame:
    marked = addresses.join(claims.select("address").distinct().withColumn("known", F.lit(True)), "address", "left")
    return marked.agg(F.count("*").alias("addresses"), F.count_if("known").alias("labelled"), F.count_if(F.col("known").isNull()).alias("unlabelled"))


def histogram(claims: DataFrame) -> DataFrame:
    return claims.groupBy("category", "source").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") <= 1).alias("low_confidence"))


def floor_of(memberships: DataFrame) -> DataFrame:
    """An entity is as sure as its least sure member."""
    return memberships.groupBy("entity").agg(F.min("confidence").alias("floor"), F.count_distinct("address").alias("members"))


def _mapped(col: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.lower(F.trim(col))]


def coerced(rows: DataFrame, source: str, default_confidence: int = 2, default_method: str = "list", most_confidence: int = 4, chain: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Imported all-text rows as claims, by header aliases without regard to case; `problem` says why a row can't be
    one. A confidence above what the source may say is lowered to that; an unknown category is `unknown`."""
    have = {c.strip().lower(): c for c in rows.columns}

    def field(name: str) -> Column:
        """The first alias that has a value in the row."""
        named = [F.nullif(F.trim(F.col(f"`{have[a]}`").cast("string")), F.lit("")) for a in COLUMNS[name] if a in have]
        return F.coalesce(*named) if named else F.lit(None).cast("string")

    sure_text, method_text, when = field("confidence"), field("method"), field("observed_at")
    sure = F.when(sure_text.isNull(), F.lit(default_confidence)).otherwise(F.coalesce(_mapped(sure_text, CONFIDENCE_WORDS), sure_text.try_cast("int")))
    method = F.when(method_text.isNull(), F.lit(default_method)).otherwise(_mapped(method_text, METHOD_WORDS))
    moment = F.coalesce(when.try_cast("long"), F.unix_timestamp(when.try_cast("timestamp")))
    place = F.coalesce(field("chain"), F.lit(chain))
    problem = (
        F.when(field("address").isNull(), "no address").when(field("label").isNull(), "no label").when(sure.isNull() | ~sure.between(0, 4), "bad confidence")
        .when(method.isNull(), "bad method").when(when.isNotNull() & moment.isNull(), "bad date").when(place.isNotNull() & ~place.rlike(CHAIN_ID), "bad chain")
    )
    lowered = stamped(sure, most_confidence).cast("int")
    return rows.select(
        field("address").alias("address"), field("label").alias("label"), place.alias("chain"), F.coalesce(_mapped(field("category"), CATEGORY_ALIASES), F.lit("unknown")).alias("category"),
        lowered.alias("confidence"), method.alias("method"), field("rationale").alias("rationale"), moment.alias("observed_at"), F.lit(source).alias("source"), problem.alias("problem"), *keep,
    )


#: Fixed: a chain as namespace and reference.
CHAIN_ID = r"^[-a-z0-9]{3,8}:[-_a-zA-Z0-9]{1,32}$"


def import_plan(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Claims (with `ord`, their place in the file) with an action each. The key is address and label without case, and
    the chain: a key's first row is an insert, later ones with its category duplicates, with another one conflicts. An
    insert whose category differs from a stored claim's of the same address is a conflict too, unless either of them is
    a sanction: that is added, never disputed."""
    w = Window.partitionBy(F.lower("address"), F.lower("label"), F.coalesce("chain", F.lit(""))).orderBy("ord")
    got = rows.withColumns({"_first": F.first("category").over(w), "_nth": F.row_number().over(w)})
    old = existing.where("category <> 'sanctioned'").groupBy(F.lower("address").alias("_a")).agg(F.collect_set("category").alias("_stored"))
    got = got.join(old, F.lower("address") == F.col("_a"), "left").drop("_a")
    clash = (F.col("category") != "sanctioned") & F.exists(F.coalesce("_stored", F.array().cast("array<string>")), lambda x: x != F.col("category"))
    inside = F.when(F.col("_first") == F.col("category"), "duplicate").otherwise("conflict")
    return got.withColumn("action", F.when(F.col("_nth") > 1, inside).when(clash, "conflict").otherwise("insert")).drop("_first", "_nth", "_stored")


def new_claims(incoming: DataFrame, existing: DataFrame, key: tuple[str, ...] = ("address", "source", "label", "analyst")) -> DataFrame:
    """Claims that an idempotent write adds: one for each key that isn't stored; null parts of a key are equal."""
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    return incoming.dropDuplicates(list(key)).alias("a").join(existing.select(*key).distinct().alias("b"), same, "left_anti")


def difference(before: DataFrame, after: DataFrame, key: str = "address") -> DataFrame:
    """(key, change): what a newer version of a list adds and removes."""
    a, b = before.select(key).distinct(), after.select(key).distinct()
    return b.join(a, key, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, key, "left_anti").withColumn("change", F.lit("removed")))


# --- watches: predicates over transfers, and their evaluation over a range of blocks


def amount_over(threshold: int, symbol: str | None = None) -> Column:
    test = F.col("amount_raw") > threshold
    return test if symbol is None else test & (F.col("symbol") == symbol)


def touching(ledger: DataFrame, claims: DataFrame, category: str, min_confidence: int = HIGH) -> DataFrame:
    """Transfers with either side in a category, and which side says so (the sender first)."""
    hits = claims.where((F.col("category") == category) & (F.col("confidence") >= min_confidence)).select("address").distinct()
    rows = ledger.join(hits.select(F.col("address").alias("sender"), F.lit(True).alias("_s")), "sender", "left").join(hits.select(F.col("address").alias("recipient"), F.lit(True).alias("_r")), "recipient", "left")
    return rows.where("_s or _r").withColumn("because", F.when(F.col("_s"), "sender").otherwise("recipient")).drop("_s", "_r")


def _other(subject: str) -> Column:
    return F.when(F.col("sender") == subject, F.col("recipient")).otherwise(F.col("sender"))


def counterparty_in(subject: str, addresses: tuple[str, ...]) -> Column:
    """Transfers of a subject with one of these addresses."""
    return ((F.col("sender") == subject) | (F.col("recipient") == subject)) & _other(subject).isin(*addresses)


def any_of(*tests: tuple[str, Column]) -> tuple[Column, Column]:
    """(whether one of the named tests holds, the names of those that do, joined by "; ")."""
    names = F.concat_ws("; ", *[F.when(t, F.lit(n)) for n, t in tests])
    return names != "", names


def all_of(*tests: tuple[str, Column]) -> tuple[Column, Column]:
    out = F.lit(True)
    for _, t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out, F.when(out, F.lit("; ".join(n for n, _ in tests)))


def unknown_counterparty(ledger: DataFrame, claims: DataFrame, subject: str) -> DataFrame:
    other = F.when(F.col("sender") == subject, F.col("recipient")).otherwise(F.col("sender"))
    rows = ledger.where((F.col("sender") == subject) | (F.col("recipient") == subject)).withColumn("other", other)
    return rows.where("other is not null").join(claims.select(F.col("address").alias("other")).distinct(), "other", "left_anti")


def evaluate(ledger: DataFrame, watches: list[tuple[str, str, Column]], since: int, until: int) -> DataFrame:
    """Events of watches (name, severity, predicate) over blocks (since, until], most urgent first. One scan: each
    transfer is tested against all watches at once."""
    order = {"urgent": 0, "notable": 1, "info": 2}
    fired = F.filter(F.array(*[F.when(test, F.struct(F.lit(name).alias("watch"), F.lit(sev).alias("severity"), F.lit(order[sev]).alias("o"))) for name, sev, test in watches]), lambda x: x.isNotNull())
    rows = ledger.where((F.col("block") > since) & (F.col("block") <= until)).withColumn("e", F.explode(fired))
    return rows.select("e.watch", "e.severity", "block", "tx_hash", "log_index", "amount_raw").orderBy(F.col("e.o"), "block", "tx_hash", "watch")


def memo_feeds(memos: DataFrame) -> DataFrame:
    """Memos (address, signer, ...) of each address's history by who wrote them: its own, those that others signed and put
    there, and who these are. Signers are compared exactly: some chains' addresses differ by case alone."""
    own = F.col("signer") == F.col("address")
    return memos.groupBy("address").agg(F.count_if(own).alias("own"), F.count_if(~F.coalesce(own, F.lit(False))).alias("injected"), F.array_sort(F.collect_set(F.when(~own, F.col("signer")))).alias("injectors"))
