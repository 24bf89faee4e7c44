"""Label and sanction lists in the forms in which they are published, as claims.

Each reader gives rows (address, chain, label, category, confidence, method, source, rationale, observed_at, problem): a
file that can't be read is one row with a problem and costs no other file its rows. What a list's layout says in the names
of its files (chain, address, category) is read from the files' hidden metadata column, so that any store can hold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the published lists. Currencies in identifiers of the sanction list, and the chains they name.
SANCTION_CHAINS = {
    "ETH": "eip155:1", "XBT": "bip122:000000000019d6689c085ae165831e93", "BTC": "bip122:000000000019d6689c085ae165831e93", "LTC": "bip122:12a765e31ffd4059bada1e25190f6e98",
    "BSC": "eip155:56", "ARB": "eip155:42161", "SOL": "solana:5eykt4UsFv8P8NJdTREpY1vzqKqZKvdp", "TRX": "tron:0x2b6653dc",
}
#: Tag packs: levels of confidence (of 100, and ours of 0 to 4), categories, and currencies' chains.
PACK_CONFIDENCE = {
    "override": (100, 3), "ownership": (100, 4), "ledger_immanent": (100, 4), "manual_transaction": (90, 3), "service_api": (70, 3), "forensic_investigation": (70, 3), "authority_data": (60, 3),
    "trusted_provider": (50, 2), "service_data": (50, 2), "forensic": (50, 2), "untrusted_transaction": (40, 2), "web_crawl": (20, 1), "heuristic": (10, 0),
}
PACK_CATEGORY = {
    "exchange": "cex", "decentralized_exchange": "dex", "defi": "dex", "mixing_service": "mixer", "bridge": "bridge", "miner": "miner", "mining_pool": "miner", "gambling": "service",
    "wallet_service": "service", "hosted_wallet": "service", "payment_processor": "service", "merchant_service": "service", "marketplace": "service", "atm": "service", "scam": "scam", "ponzi_scheme": "scam",
    "sextortion": "scam", "phishing": "scam", "ransomware": "illicit", "darknet_market": "illicit", "stolen_funds": "illicit", "theft": "illicit", "malware": "illicit", "sanctions": "sanctioned", "terrorism_financing": "sanctioned",
}
PACK_CHAIN = {
    "BTC": "bip122:000000000019d6689c085ae165831e93", "ETH": "eip155:1", "BCH": "bip122:000000000000000000651ef99cb9fcbe", "LTC": "bip122:12a765e31ffd4059bada1e25190f6e98",
    "ZEC": "bip122:0000000000196a45a4f0a1b0e5a0d4b6", "TRX": "tron:mainnet",
}
#: Files of a folder of labels by category, in the order in which they decide, and what they mean.
FOLDER_CATEGORY = {"exchange": "cex", "phish-hack": "illicit", "token-contract": "token", "genesis": "contract"}
MAINNET = "eip155:1"
#: Words of explorers' name tags, the first kind with one of them in the label or the tags counts.
NAMETAG_WORDS = {
    "mixer": ("tornado", "mixer", "coinjoin", "wasabi"),
    "illicit": ("phish", "hack", "exploit", "heist", "drainer", "ransom"),
    "scam": ("scam", "fake", "spam", "honeypot"),
    "bridge": ("bridge", "wormhole", "across", "stargate"),
    "cex": ("exchange", "cex", "binance", "coinbase", "kraken", "okx", "kucoin", "bitfinex", "huobi", "gate.io", "bybit", "bitstamp", "gemini", "crypto.com", "hitbtc", "mexc"),
    "dex": ("uniswap", "sushiswap", "curve", "balancer", "dex", "0x", "1inch", "pancakeswap"),
    "token": ("token", "erc20", "stablecoin"),
    "miner": ("miner", "mining", "pool"),
}

CLAIM = ("address", "chain", "label", "category", "confidence", "method", "source", "rationale", "observed_at", "problem")


def _map(table: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def _moment(text: Column) -> Column:
    """Seconds since 1970 of a written date, in UTC where it names no zone; null where it is none, never the present."""
    return F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(F.trim(text.cast("string")), r"^(\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?)$", "$1Z")))


def folded(address: Column) -> Column:
    """Hexadecimal addresses in lower case; others keep theirs, where it tells addresses apart."""
    plain = F.trim(address)
    return F.when(plain.rlike("^0[xX]") & (F.length(plain) == 42), F.lower(plain)).otherwise(plain)


def _claims(rows: DataFrame, **columns: Column | str | int | None) -> DataFrame:
    """rows as claims: columns that aren't given are null."""
    kinds = {"confidence": "int", "observed_at": "long"}
    made = {c: columns.get(c) for c in CLAIM}
    return rows.select(*[(v if isinstance(v, Column) else F.lit(v)).cast(kinds.get(c, "string")).alias(c) for c, v in made.items()])


def _path() -> Column:
    return F.col("_metadata.file_path")


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


# --- sanctions


def sanctions_xml(spark: SparkSession, path: str) -> DataFrame:
    """Digital-currency addresses of a sanction list in XML: each entry's identifiers, with the entry's name; a currency
    without an unambiguous chain gives no chain. The list's own date is kept, and an address's last identifier counts."""
    entry = "lastName string, publishDate string, idList struct<id:array<struct<idType:string,idNumber:string>>>"
    rows = spark.read.format("xml").options(rowTag="sdnEntry", mode="PERMISSIVE", ignoreNamespace="true").schema(entry).load(path).withColumn("_file", _path())
    rows = rows.select("_file", "lastName", F.posexplode("idList.id").alias("at", "id"))
    hint = F.upper(F.regexp_extract("id.idType", r"(?i)Digital Currency Address\s*-\s*([A-Z0-9]+)", 1))
    rows = rows.withColumn("hint", hint).where((F.col("hint") != "") & (F.trim("id.idNumber") != ""))
    issued = spark.read.format("xml").options(rowTag="publshInformation", ignoreNamespace="true").schema("Publish_Date string").load(path).select(_path().alias("_file"), F.unix_timestamp(F.try_to_timestamp("Publish_Date", F.lit("MM/dd/yyyy"))).alias("issued")).dropDuplicates(["_file"])
    rows = rows.join(F.broadcast(issued), "_file", "left")  # one row a file
    address = folded(F.col("id.idNumber"))
    name = F.trim("lastName")
    label = F.concat(F.lit("OFAC SDN"), F.when(name != "", F.concat(F.lit(" ("), name, F.lit(")"))).otherwise(F.lit("")))
    chain = F.try_element_at(_map(SANCTION_CHAINS), F.col("hint"))
    why = F.when(chain.isNull(), F.concat(F.lit("currency hint "), F.col("hint")))
    got = _claims(rows, address=address, chain=chain, label=label, category="sanctioned", confidence=4, method="list", source="ofac", rationale=why, observed_at=F.col("issued"))
    return got.dropDuplicates(["address", "chain"])


def sanctions_json(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot of such a list: an object of addresses, or under `addresses`, with label and chain each, and the date of
    the snapshot in `_snapshot` or `fetched_at`."""
    whole = spark.read.text(path, wholetext=True)
    top = F.from_json("value", "map<string,string>")
    inner = F.coalesce(F.from_json(F.try_element_at(top, F.lit("addresses")), "map<string,string>"), top)
    when = _moment(F.coalesce(F.try_element_at(top, F.lit("_snapshot")), F.try_element_at(top, F.lit("fetched_at"))))
    rows = whole.select(when.alias("when"), F.explode(inner).alias("address", "raw")).where(~F.col("address").startswith("_") & F.col("raw").startswith("{"))
    fields = F.from_json("raw", "struct<label:string,chain:string>")
    return _claims(rows, address=folded(F.col("address")), chain=fields["chain"], label=F.coalesce(fields["label"], F.lit("OFAC SDN")), category="sanctioned", confidence=4, method="list", source="ofac", observed_at=F.col("when"))


# --- tag packs: a data source whose partitions are files


PACK = "pack string, tag map<string,string>, problem string"


class _PackFiles(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TagPackReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path  # files that the driver and the executors see

        return [_PackFiles(str(p)) for p in sorted(Path(self.options["path"]).rglob("*.yaml"))] or [_PackFiles("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.path:
            return
        with open(partition.path, encoding="utf-8", errors="replace") as f:
            yield from pack_tags(partition.path, f.read())


class TagPacks(DataSource):
    """`spark.read.format("tagpack").load(folder)`, once registered: each tag of each pack below a folder that all machines
    see, with the pack's header fields. `tag_packs` reads from any store."""

    @classmethod
    def name(cls) -> str:
        return "tagpack"

    def schema(self) -> str:
        return PACK

    def reader(self, schema: object) -> DataSourceReader:
        return TagPackReader(self.options)


def pack_tags(path: str, text: str) -> Iterator[tuple]:
    """(pack, fields, problem) of a pack's tags: the header's fields, then the tag's own, which win."""
    import yaml

    name = path.rsplit("/", 1)[-1]
    try:
        pack = yaml.safe_load(text)
    except yaml.YAMLError as e:
        yield name, None, f"bad file: {str(e).splitlines()[0]}"
        return
    if not isinstance(pack, dict):
        yield name, None, "bad file: no mapping"
        return
    header = {k: v for k, v in pack.items() if k != "tags"}
    for tag in pack.get("tags") or ():
        if isinstance(tag, dict):
            yield name, {str(k): str(v) for k, v in {**header, **tag}.items() if v is not None}, None
        else:
            yield name, None, "bad tag"


def tag_packs(spark: SparkSession, path: str) -> DataFrame:
    """Claims of all tag packs below a folder. The packs' own level of confidence stays in the rationale."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter="*.yaml").load(path).select("path", F.col("content").cast("string").alias("text"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                yield pd.DataFrame(list(pack_tags(path, text)), columns=["pack", "tag", "problem"])

    rows = files.mapInPandas(read, PACK)
    field = lambda c: F.nullif(F.trim(F.try_element_at("tag", F.lit(c))), F.lit(""))
    level = F.try_element_at(_map({k: v for k, (_, v) in PACK_CONFIDENCE.items()}), field("confidence"))
    points = F.try_element_at(_map({k: v for k, (v, _) in PACK_CONFIDENCE.items()}), field("confidence"))
    code = F.upper(F.coalesce(field("network"), field("currency")))
    why = F.concat_ws("; ", F.concat(F.lit("tagpack "), F.col("pack")), F.concat(F.lit("confidence="), field("confidence"), F.lit(" ("), F.coalesce(points, F.lit(0)), F.lit("/100)")), F.concat(F.lit("actor="), field("actor")), F.substring(field("context"), 1, 200))
    problem = F.coalesce("problem", F.when(field("address").isNull(), "no address").when(field("label").isNull(), "no label"))
    return _claims(
        rows, address=folded(field("address")), chain=F.try_element_at(_map(PACK_CHAIN), code), label=field("label"), category=F.coalesce(F.try_element_at(_map(PACK_CATEGORY), F.lower(field("category"))), F.lit("unknown")),
        confidence=F.coalesce(level, F.lit(0)), method="list", source=F.concat(F.coalesce(field("title"), F.lit("TagPack")), F.lit(" via "), F.coalesce(field("creator"), F.lit("unknown creator"))), rationale=why, observed_at=_moment(field("lastmod")), problem=problem,
    )


# --- folders and files of labels


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """(value, _file): each file below a path as one text."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True).select("value", _path().alias("_file"))


def labels_by_category(spark: SparkSession, path: str) -> DataFrame:
    """A folder of lists [{address, nameTag}], one file a category. A file's place among the categories decides where an
    address is in several; an address without a name is labelled by its category."""
    names = list(FOLDER_CATEGORY)
    rows = _documents(spark, path).withColumn("kind", _stem(F.col("_file"))).where(F.col("kind").isin(*names))
    each = F.from_json("value", "array<struct<address:string,nameTag:string>>")
    rows = rows.withColumn("bad", each.isNull()).select("kind", "bad", F.posexplode_outer(each).alias("at", "x"))
    rows = rows.withColumn("address", F.lower(F.trim("x.address"))).where("bad or address <> ''")
    first = Window.partitionBy("address").orderBy(F.array_position(F.array(*map(F.lit, names)), F.col("kind")), "at")
    good = rows.where("not bad").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    rows = good.unionByName(rows.where("bad"))
    label = F.coalesce(F.nullif(F.trim("x.nameTag"), F.lit("")), F.concat("kind", F.lit(" (unnamed in the source)")))
    return _claims(rows, address=F.when(~F.col("bad"), F.col("address")), chain=MAINNET, label=F.when(~F.col("bad"), label), category=_map(FOLDER_CATEGORY)[F.col("kind")], confidence=2, method="list", source=F.concat(F.lit("eth-labels "), F.col("kind")), rationale=F.concat(F.lit("listed under "), F.col("kind")), problem=F.when(F.col("bad"), "bad file"))


def contract_registry(spark: SparkSession, path: str) -> DataFrame:
    """A folder contracts/<chain number>/<address>.json: chain and address are the file's place, the file says project,
    name and where it knows them from. A file without either name is no claim."""
    rows = _documents(spark, path).withColumn("fields", F.from_json("value", "struct<project:string,name:string,source:string>"))
    rows = rows.withColumns({"chain": F.regexp_extract("_file", r"/contracts/(\d+)/0[xX][^/]*\.json$", 1), "address": F.lower(_stem(F.col("_file")))}).where("chain <> ''")
    label = F.nullif(F.concat_ws(" ", F.nullif(F.trim("fields.project"), F.lit("")), F.nullif(F.trim("fields.name"), F.lit(""))), F.lit(""))
    bad = ~F.coalesce(F.trim("value").startswith("{"), F.lit(False)) | F.col("fields").isNull() | F.get_json_object("value", "$").isNull()
    rows = rows.withColumns({"label": label, "bad": bad}).where("bad or label is not null")
    from_ = F.coalesce(F.nullif(F.trim("fields.source"), F.lit("")), F.lit("no source recorded"))
    why = F.concat(F.lit("a deployment of "), F.coalesce(F.nullif(F.trim("fields.project"), F.lit("")), F.lit("an unnamed project")))
    return _claims(rows, address=F.col("address"), chain=F.concat(F.lit("eip155:"), "chain"), label=F.col("label"), category="contract", confidence=2, method="list", source=F.concat(F.lit("contract registry ("), from_, F.lit(")")), rationale=why, problem=F.when(F.col("bad"), "bad file"))


def darklist(spark: SparkSession, path: str) -> DataFrame:
    """Reported scams [{address, comment, date}]: an address's first entry counts; the label is the report's first clause."""
    whole = spark.read.text(path, wholetext=True)
    each = F.from_json("value", "array<struct<address:string,comment:string,date:string>>")
    rows = whole.withColumn("bad", each.isNull()).select("bad", F.posexplode_outer(each).alias("at", "x")).withColumn("address", folded(F.col("x.address"))).where("bad or address <> ''")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("address").orderBy("at"))).where("bad or _n = 1")
    comment = F.nullif(F.trim("x.comment"), F.lit(""))
    label = F.coalesce(F.nullif(F.substring(F.trim(F.split(F.split(comment, r"\.")[0], " this ")[0]), 1, 60), F.lit("")), F.lit("reported address"))
    when = _moment(F.col("x.date"))
    day = F.date_format(F.timestamp_seconds(when), "yyyy-MM-dd")
    why = F.coalesce(F.concat(comment, F.lit(" [reported "), day, F.lit("]")), comment, F.lit("listed with no comment"))
    return _claims(rows, address=F.col("address"), chain=MAINNET, label=label, category="scam", confidence=2, method="list", source="darklist", rationale=why, observed_at=when, problem=F.when(F.col("bad"), "bad file"))


def nametags(spark: SparkSession, path: str) -> DataFrame:
    """A dump of explorers' name tags, an object of addresses with label, chain and tags each; the category follows from
    words in label and tags."""
    whole = spark.read.text(path, wholetext=True)
    each = F.when(F.ltrim("value").startswith("{"), F.from_json("value", "map<string,string>"))
    rows = whole.withColumn("bad", each.isNull()).select("bad", F.explode_outer(each).alias("address", "raw")).where("bad or not startswith(address, '_') and startswith(raw, '{')")
    rows = rows.withColumn("f", F.from_json("raw", "struct<label:string,name:string,chain:string,tags:array<string>>"))
    said = F.lower(F.concat_ws(" ", F.coalesce("f.label", "f.name"), F.coalesce("f.tags", F.array().cast("array<string>"))))
    has = lambda words: reduce(lambda a, b: a | b, [F.contains(said, F.lit(w)) for w in words])
    kind = F.coalesce(*[F.when(has(words), category) for category, words in NAMETAG_WORDS.items()], F.lit("service"))
    return _claims(rows, address=F.lower("address"), chain=F.col("f.chain"), label=F.when(~F.col("bad"), F.coalesce("f.label", "f.name", F.lit("labelled"))), category=kind, confidence=3, method="label", source="explorer nametags", problem=F.when(F.col("bad"), "bad file"))
