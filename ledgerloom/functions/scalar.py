"""Column functions: address identity, amounts as text, indicators in text, odds. All stay in the JVM except what needs
Unicode's tables (skeletons, scripts), Keccak or Base58, which are vectorised Python over Arrow batches."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut


def address_key(chain: Column, raw: Column) -> Column:
    """The join key of an address: what a chain compares addresses by. Base58 chains keep their case."""
    t = F.trim(raw)
    hex_body = F.regexp_replace(F.lower(t), "^0x", "")
    return (
        F.when(chain.startswith("eip155:"), F.lower(t))
        .when(chain.startswith("bip122:"), F.when(F.lower(t).startswith("bc1"), F.lower(t)).otherwise(t))
        .when(chain.startswith("sui:"), F.concat(F.lit("0x"), F.lpad(hex_body, 64, "0")))
        .otherwise(F.when(t.rlike("^0x[0-9a-fA-F]{40}$"), F.lower(t)).otherwise(t))
    )


def valid_address(chain: Column, raw: Column) -> Column:
    return (
        F.when(chain.startswith("eip155:"), raw.rlike("^0x[0-9a-fA-F]{40}$"))
        .when(chain.startswith("bip122:"), raw.rlike("^(bc1[02-9ac-hj-np-z]{11,71}|[13][1-9A-HJ-NP-Za-km-z]{25,34})$"))
        .when(chain.startswith("sui:"), raw.rlike("^0x[0-9a-fA-F]{1,64}$"))
        .when(chain.isNull(), (F.length(raw) >= 25) & ~raw.rlike(r"\s"))
        .otherwise(raw.rlike("^[1-9A-HJ-NP-Za-km-z]{32,44}$"))
    )


def bitcoin_kind(raw: Column) -> Column:
    t = F.lower(raw)
    return F.when(t.startswith("bc1p"), "p2tr").when(t.startswith("bc1q"), F.when(F.length(raw) == 42, "p2wpkh").otherwise("p2wsh")).when(raw.startswith("1"), "p2pkh").when(raw.startswith("3"), "p2sh")


def human(raw: Column, decimals: Column) -> Column:
    """An exact amount as text: thousands grouped, six places cut (more while the number starts with zeros), trailing
    zeros dropped; without decimals the raw number is named as such. No floating point anywhere."""
    sign = F.when(raw < 0, "-").otherwise("")
    digits = F.regexp_replace(F.abs(raw).cast("string"), r"\..*$", "")
    padded = F.lpad(digits, F.greatest(F.length(digits), decimals + 1).cast("int"), F.lit("0"))
    whole = F.substr(padded, F.lit(1), F.length(padded) - decimals)
    part = F.when(decimals > 0, F.substr(padded, F.length(padded) - decimals + 1, decimals)).otherwise("")
    zeros = F.length(F.regexp_extract(part, "^0*", 0))
    places = F.when(whole == "0", F.greatest(F.lit(6), zeros + 6)).otherwise(F.lit(6))
    shown = F.regexp_replace(F.substr(part, F.lit(1), places), "0+$", "")
    grouped = F.regexp_replace(whole, r"(?<=\d)(?=(\d{3})+$)", ",")
    return F.when(decimals.isNull(), F.concat(F.abs(raw).cast("string"), F.lit(" raw"))).otherwise(F.concat(sign, grouped, F.when(shown != "", F.concat(F.lit("."), shown)).otherwise("")))


def parse_amount(text: Column, decimals: Column) -> Column:
    """Decimal text as raw units; null if it isn't a number or has more places than the unit."""
    ok = text.rlike(r"^\d+(\.\d+)?$")
    whole = F.regexp_extract(text, r"^(\d+)", 1)
    part = F.regexp_replace(F.regexp_extract(text, r"\.(\d+)$", 1), "0+$", "")
    return F.when(ok & (F.length(part) <= decimals), F.concat(whole, F.rpad(part, decimals.cast("int"), F.lit("0"))).try_cast("decimal(38,0)"))


def collision_chance(count: Column, edges: int = 4) -> Column:
    """Odds that some of `count` random addresses share their first and last `edges` hex digits."""
    pairs = count.cast("double") * (count - 1) / 2
    return F.when(count < 2, F.lit(0.0)).otherwise(1 - F.exp(-pairs / float(2 ** (8 * edges))))


def rising_chance(steps: Column) -> Column:
    """Odds that so many different amounts come in rising order by chance."""
    return F.lit(1.0) / F.factorial(steps.cast("int"))


def selector(input_data: Column) -> Column:
    return F.when(F.length(input_data) >= 10, F.lower(F.substring(input_data, 3, 8)))


def ipv4(text: Column) -> Column:
    """Distinct IPv4 addresses in order."""
    hits = F.regexp_extract_all(text, F.lit(r"(?<![\d.])(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?![\d.])"), 1)
    return F.array_distinct(F.filter(hits, lambda x: F.forall(F.split(x, r"\."), lambda o: o.cast("int") <= 255)))


def urls(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(https?://[^\s\"'<>]+)"), 1))


def indicators(rows: DataFrame, text: str, key: str, depth: int = 32) -> DataFrame:
    """(key, kind, value): distinct IPv4 addresses, URLs and ports of each row's text. JSON texts are also read as a
    structure, level by level to any depth up to `depth`: what stands under a name that contains `port` is a port, and
    strings are searched for addresses. Other texts have no ports."""
    spark = rows.sparkSession
    plain = rows.select(key, F.explode(F.concat(F.transform(ipv4(F.col(text)), lambda x: F.struct(F.lit("ipv4").alias("kind"), x.alias("value"))), F.transform(urls(F.col(text)), lambda x: F.struct(F.lit("url").alias("kind"), x.alias("value"))))).alias("i")).select(key, "i.*")
    # in brackets, as a parser takes what stands behind a document for no fault: one document is a list of one
    alone = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    level = rows.select(key, alone.alias("a"), F.lit("").alias("name")).where("size(a) = 1").select(key, F.col("a")[0].alias("v"), "name")
    out = plain
    for _ in range(depth):
        inner = level.where(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")).lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("_pos", "_key", "_value"))
        level = cut(inner.select(key, F.col("_value").alias("v"), F.coalesce("_key", "name").alias("name")), "json-level")
        if level.isEmpty():
            break
        leaves = level.where(~F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")).select(key, "name", F.schema_of_variant("v").alias("type"), F.try_variant_get("v", "$", "string").alias("s"))
        port = F.lower("name").contains("port") & F.col("type").isin("BIGINT", "STRING")
        out = out.unionByName(leaves.where(port).select(key, F.lit("port").alias("kind"), F.col("s").alias("value")))
        found = leaves.where(~port & (F.col("type") == "STRING")).select(key, F.explode(ipv4(F.col("s"))).alias("value"))
        out = out.unionByName(found.select(key, F.lit("ipv4").alias("kind"), "value"))
    return out.distinct()


def qualified(label: Column, confidence: Column) -> Column:
    word = F.when(confidence >= 3, "").when(confidence == 2, "probably ").when(confidence == 1, "possibly ").otherwise("speculatively ")
    return F.concat(word, label)


#: Letters of other writing systems and the ASCII characters that they pass for. Full-width and mathematical
#: letters need no entry, as compatibility decomposition makes ASCII of them.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w", "г": "r", "п": "n",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "υ": "u", "κ": "k", "ι": "i", "τ": "t", "χ": "x", "γ": "y",
    # Armenian and Cherokee
    "Ց": "S", "Օ": "O", "Ա": "U", "Ꭰ": "D", "Ꭼ": "E", "Ꮋ": "H", "Ꮑ": "N", "Ꭺ": "A", "Ꮯ": "C", "Ꮮ": "L", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮷ": "J", "Ꮖ": "I", "Ꮶ": "K", "Ꮟ": "b", "Ᏼ": "B", "Ᏽ": "Y",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓤ": "Z", "ꓥ": "V", "ꓧ": "H", "ꓪ": "W", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U", "ꓸ": ".",
}
_LOOK = str.maketrans(LOOKALIKES)
_NO_WIDTH = ("Mn", "Me", "Cf", "Cc")


def skeleton(text: Column) -> Column:
    """What a name looks like: compatibility forms, no marks or invisible characters, lookalikes as ASCII; case stays."""

    def one(t: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFKD", t) if unicodedata.category(c) not in _NO_WIDTH).translate(_LOOK)

    return F.pandas_udf(lambda s: s.map(one, na_action="ignore"), "string")(text)


def scripts(text: Column) -> Column:
    """The distinct writing systems of a name's letters, by the first word of their Unicode names."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: sorted({unicodedata.name(c, "UNKNOWN").split()[0] for c in unicodedata.normalize("NFKC", t or "") if c.isalpha()}))

    return F.pandas_udf(run, "array<string>")(text)


def code_body(code: Column) -> Column:
    """Contract bytecode (hex) without the metadata trailer that its last two bytes measure."""
    hexed = F.lower(F.regexp_replace(code, "^0x", ""))
    n = F.conv(F.right(hexed, F.lit(4)), 16, 10).cast("int")
    return F.when((n <= 256) & (F.length(hexed) > 2 * n + 4), F.substr(hexed, F.lit(1), F.length(hexed) - 2 * n - 4)).otherwise(hexed)


# --- hashes and encodings of addresses

_ROUNDS, _LANE = 24, (1 << 64) - 1
_ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_VALUE = {c: k for k, c in enumerate(_ALPHABET)}


def _round_constants() -> list[int]:
    """Keccak's round constants, from the linear feedback register that defines them."""
    out, r = [], 1
    for _ in range(_ROUNDS):
        value = 0
        for j in range(7):
            value |= (r & 1) << (1 << j) - 1
            r = r << 1 ^ (r >> 7) * 0x171
        out.append(value)
    return out


_CONSTANTS = _round_constants()


def _permuted(a: list[int]) -> list[int]:
    """Keccak-f[1600] over 25 lanes (lane x + 5 y)."""

    def turn(v: int, n: int) -> int:
        return (v << n | v >> 64 - n) & _LANE

    for constant in _CONSTANTS:
        c = [a[x] ^ a[x + 5] ^ a[x + 10] ^ a[x + 15] ^ a[x + 20] for x in range(5)]
        a = [a[i] ^ c[(i + 4) % 5] ^ turn(c[(i + 1) % 5], 1) for i in range(25)]
        b, x, y, held = [a[0]] + [0] * 24, 1, 0, a[1]
        for t in range(24):  # rho turns lanes by triangular numbers along pi's cycle
            x, y = y, (2 * x + 3 * y) % 5
            held, b[x + 5 * y] = a[x + 5 * y], turn(held, (t + 1) * (t + 2) // 2 % 64)
        a = [b[i] ^ ~b[i - i % 5 + (i + 1) % 5] & _LANE & b[i - i % 5 + (i + 2) % 5] for i in range(25)]
        a[0] ^= constant
    return a


def _turns() -> tuple[np.ndarray, np.ndarray]:
    """Rho and pi at once: the lane that comes to each place, and by how much it is turned."""
    source, by, x, y, held = np.zeros(25, np.int64), np.zeros(25, np.uint64), 1, 0, 1
    for t in range(24):
        x, y = y, (2 * x + 3 * y) % 5
        source[x + 5 * y], by[x + 5 * y], held = held, (t + 1) * (t + 2) // 2 % 64, x + 5 * y
    return source, by[:, None]


_SOURCE, _LEFT = _turns()
_RIGHT = (np.uint64(64) - _LEFT) % np.uint64(64)
#: States permuted at once: what their lanes take stays near the processor.
_STATES = 1024


def _permuted_all(a: np.ndarray) -> np.ndarray:
    """`_permuted` for (25, states) lanes."""
    one, rest = np.uint64(1), np.uint64(63)
    for constant in _CONSTANTS:
        planes = a.reshape(5, 5, -1)
        c = planes[0] ^ planes[1] ^ planes[2] ^ planes[3] ^ planes[4]
        up = c[[1, 2, 3, 4, 0]]
        a = (planes ^ (c[[4, 0, 1, 2, 3]] ^ (up << one | up >> rest))).reshape(25, -1)[_SOURCE]
        b = (a << _LEFT | a >> _RIGHT).reshape(5, 5, -1)
        a = (b ^ ~b[:, [1, 2, 3, 4, 0]] & b[:, [2, 3, 4, 0, 1]]).reshape(25, -1)
        a[0] ^= np.uint64(constant)
    return a


def keccak256(data: bytes) -> bytes:
    """Keccak-256 with the original padding, as account chains use it."""
    rate = 136
    padded = bytearray(data + b"\x01" + b"\x00" * (-(len(data) + 1) % rate))
    padded[-1] |= 0x80
    state = [0] * 25
    for at in range(0, len(padded), rate):
        for i in range(rate // 8):
            state[i] ^= int.from_bytes(padded[at + 8 * i : at + 8 * i + 8], "little")
        state = _permuted(state)
    return b"".join(x.to_bytes(8, "little") for x in state[:4])


_RATE = 136


def keccak256_of_all(messages: list[bytes]) -> np.ndarray:
    """Keccak-256 of many messages at once: (messages, 32) bytes. The lanes of many states are one array, so the rounds run
    once for each block that the longest of them has, not once for each message."""
    parts = [_keccak_of_some(messages[at : at + _STATES]) for at in range(0, len(messages), _STATES)]
    return np.concatenate(parts) if parts else np.zeros((0, 32), np.uint8)


def _keccak_of_some(messages: list[bytes]) -> np.ndarray:
    n = len(messages)
    sizes = np.fromiter(map(len, messages), np.int64, n)
    blocks = sizes // _RATE + 1
    state = np.zeros((25, n), np.uint64)
    for k in range(int(blocks.max())):
        on = np.flatnonzero(blocks > k)
        part = np.frombuffer(b"".join(messages[i][k * _RATE : (k + 1) * _RATE].ljust(_RATE, b"\0") for i in on.tolist()), np.uint8).reshape(-1, _RATE).copy()
        last = np.flatnonzero(blocks[on] == k + 1)
        part[last, sizes[on[last]] - k * _RATE] ^= 1
        part[last, -1] ^= 0x80
        now = state[:, on]
        now[: _RATE // 8] ^= part.view("<u8").T
        state[:, on] = _permuted_all(now)
    return np.ascontiguousarray(state[:4].T).astype("<u8").view(np.uint8).reshape(n, 32)


def checksummed(raw: Column) -> Column:
    """A hex address in mixed case by its Keccak checksum (EIP-55); null for what isn't one."""

    def run(given: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(given), index=given.index, dtype=object)
        ok = given.str.fullmatch("0x[0-9a-fA-F]{40}").fillna(False).astype(bool).to_numpy()
        body = [t[2:].lower().encode() for t in given[ok]]
        if body:
            digest = keccak256_of_all(body)[:, :20]
            high = np.stack([digest >> 7, digest >> 3 & 1], axis=2).reshape(-1, 40)  # a letter is upper where its digit is above 7
            text = np.frombuffer(b"".join(body), np.uint8).reshape(-1, 40)
            mixed = (text - 32 * (high & (text >= ord("a")))).astype(np.uint8).tobytes().decode()
            out[ok] = ["0x" + mixed[at : at + 40] for at in range(0, len(mixed), 40)]
        return out

    return F.pandas_udf(run, "string")(raw)


def valid_checksum(raw: Column) -> Column:
    """Addresses all in lower or all in upper case claim no checksum and pass."""
    body = F.substring(raw, 3, 40)
    return raw.rlike("^0x[0-9a-fA-F]{40}$") & ((body == F.lower(body)) | (body == F.upper(body)) | (raw == checksummed(raw)))


def base58_of_hex(raw: Column) -> Column:
    """A Tron address (hex with prefix 41) in Base58 with its double SHA-256 check; null for what isn't one."""

    def one(t: str) -> str | None:
        body = t.lower().removeprefix("0x")
        body = body if len(body) == 42 else f"41{body}"
        if not re.fullmatch("41[0-9a-f]{40}", body):
            return None
        data = bytes.fromhex(body)
        n, out = int.from_bytes(data + hashlib.sha256(hashlib.sha256(data).digest()).digest()[:4]), ""
        while n:
            n, k = divmod(n, 58)
            out = _ALPHABET[k] + out
        return out

    return F.pandas_udf(lambda s: s.map(one, na_action="ignore"), "string")(raw)


def hex_of_base58(raw: Column) -> Column:
    """The reverse; null where the check fails."""

    def one(t: str) -> str | None:
        if not t or not _VALUE.keys() >= set(t):
            return None
        n = 0
        for c in t:
            n = n * 58 + _VALUE[c]
        if n >= 1 << 200:
            return None
        data = n.to_bytes(25)
        return data[:21].hex() if data[0] == 0x41 and hashlib.sha256(hashlib.sha256(data[:21]).digest()).digest()[:4] == data[21:] else None

    return F.pandas_udf(lambda s: s.map(one, na_action="ignore"), "string")(raw)


def namehash(name: Column) -> Column:
    """The node of a dotted name (ENS): labels hashed from the right; null for names with empty labels."""

    def one(t: str) -> str | None:
        node = bytes(32)
        labels = t.lower().split(".") if t else []
        if "" in labels:
            return None
        for label in reversed(labels):
            node = keccak256(node + keccak256(label.encode()))
        return "0x" + node.hex()

    return F.pandas_udf(lambda s: s.map(one, na_action="ignore"), "string")(name)


def coin_type(raw: Column) -> Column:
    """A Sui coin type with its package address in full length."""
    package = F.regexp_extract(raw, "^0x([0-9a-fA-F]+)::", 1)
    return F.when(package != "", F.concat(F.lit("0x"), F.lpad(F.lower(package), 64, "0"), F.regexp_replace(raw, "^0x[0-9a-fA-F]+", ""))).otherwise(raw)


#: Fixed: names of chains and their ids.
CHAINS = {"ethereum": "eip155:1", "eth": "eip155:1", "bsc": "eip155:56", "polygon": "eip155:137", "arbitrum": "eip155:42161", "base": "eip155:8453", "optimism": "eip155:10", "bitcoin": "bip122:000000000019d6689c085ae165831e93"}


def chain_id(text: Column) -> Column:
    """A chain by name, number or id; null for what isn't known."""
    t = F.lower(F.trim(text))
    named = F.create_map(*[F.lit(x) for kv in CHAINS.items() for x in kv])[t]
    return F.coalesce(named, F.when(t.rlike(r"^\d+$"), F.concat(F.lit("eip155:"), t)).when(F.trim(text).rlike(r"^[-a-z0-9]{3,8}:[-_a-zA-Z0-9]{1,32}$"), F.trim(text)))


def abi_word(data: Column, n: int) -> Column:
    """The n-th 64-digit word of call or log data; null beyond its end."""
    body = F.regexp_replace(data, "^0x", "")
    return F.when(F.length(body) >= 64 * (n + 1), F.substr(body, F.lit(64 * n + 1), F.lit(64)))


def topic_address(topic: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.right(topic, F.lit(40))))


def amount_ratio(a: Column, b: Column, same_unit: Column) -> Column:
    """a / b where both are of one unit and b isn't zero; else null."""
    return F.when(same_unit & (b != 0), a.cast("double") / b.cast("double"))


def memo_text(raw: Column) -> Column:
    """A memo as text: base64 of printable UTF-8 is decoded, anything else stays."""
    data = F.when((F.length(raw) % 4 == 0) & raw.rlike("^[A-Za-z0-9+/]+={0,2}$"), F.unbase64(raw))
    text = data.cast("string")
    return F.when(F.is_valid_utf8(text) & text.rlike(r"^[^\p{Cntrl}]+$"), text).otherwise(raw)


def stamped(confidence: Column, most: int) -> Column:
    """A confidence lowered to what its source may say."""
    return F.least(confidence, F.lit(most))


def code_family(code: Column) -> Column:
    """What contracts of one code share: the hash of the body without its metadata; null without code."""
    return F.when(F.length(F.regexp_replace(F.coalesce(code, F.lit("")), "^0x", "")) > 0, F.md5(code_body(code).cast("binary")))


def keccak_hex(data: Column) -> Column:
    """Keccak-256 of bytes as 64 hexadecimal digits, a whole batch at once; null stays."""

    def run(given: pd.Series) -> pd.Series:
        out, known = np.full(len(given), None, object), given.notna().to_numpy()
        digits = keccak256_of_all([bytes(x) for x in given[known]]).tobytes().hex()
        out[known] = [digits[at : at + 64] for at in range(0, len(digits), 64)]
        return pd.Series(out, index=given.index)

    return F.pandas_udf(run, "string")(data)


def _account(address: Column) -> Column:
    """An account's 40 digits; null for what isn't one."""
    return F.when(address.rlike("^0[xX][0-9a-fA-F]{40}$"), F.lower(F.substring(address, 3, 40)))


def created_address(deployer: Column, nonce: Column) -> Column:
    """The address of the contract that an account creates with a nonce: Keccak of both, length-prefixed (RLP); null for
    what isn't an account or a negative nonce."""
    digits = F.lower(F.hex(nonce.cast("long")))
    digits = F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits)
    number = F.when(nonce == 0, "80").when(nonce < 0x80, digits).otherwise(F.concat(F.lower(F.hex((F.lit(0x80) + F.length(digits) / 2).cast("long"))), digits))
    body = F.concat(F.lit("94"), _account(deployer), number)
    return F.concat(F.lit("0x"), F.right(keccak_hex(F.unhex(F.when(nonce >= 0, F.concat(F.lower(F.hex((F.lit(0xC0) + F.length(body) / 2).cast("long"))), body)))), F.lit(40)))


def created_keys(deployer: Column, search: int) -> Column:
    """For the nonces 0 .. search - 1 of an account: bytes 4 to 11 of each address that it creates, as a signed number: what
    `address_number` gives for the address. Null for what isn't an account."""
    numbers = [b"\x80" if n == 0 else bytes([n]) if n < 0x80 else bytes([0x80 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8) for n in range(search)]
    form = np.frombuffer(b"".join((bytes([0xC0 + 21 + len(x), 0x94]) + bytes(20) + x + b"\x01").ljust(_RATE - 1, b"\0") + b"\x80" for x in numbers), np.uint8).reshape(search, _RATE)
    step = max(1, _STATES // max(1, search))

    def run(given: pd.Series) -> pd.Series:
        out = np.full(len(given), None, object)
        known = np.flatnonzero(given.notna().to_numpy())
        accounts = np.frombuffer(bytes.fromhex("".join(given.iloc[known])), np.uint8).reshape(-1, 1, 20)
        for at in range(0, len(known), step):
            some = np.repeat(form[None], len(accounts[at : at + step]), axis=0)
            some[:, :, 2:22] = accounts[at : at + step]
            state = np.zeros((25, some.shape[0] * search), np.uint64)
            state[: _RATE // 8] = some.reshape(-1, _RATE).view("<u8").T
            for i, keys in zip(known[at : at + step].tolist(), _permuted_all(state)[2].byteswap().view(np.int64).reshape(-1, search), strict=True):
                out[i] = keys
        return pd.Series(out, index=given.index)

    return F.pandas_udf(run, "array<long>")(_account(deployer))


def address_number(address: Column) -> Column:
    """Bytes 4 to 11 of an address as a signed number; null for what isn't one."""
    return F.conv(F.substring(_account(address), 9, 16), 16, -10).cast("long")


def create2_address(deployer: Column, salt: Column, code_hash: Column) -> Column:
    """The address of a contract created with a salt, from the hash of its code: Keccak of 255, account, salt and hash (the
    latter two of 32 bytes, hexadecimal); null where one isn't of its length."""
    word = lambda c: F.when(c.rlike("^(0[xX])?[0-9a-fA-F]{64}$"), F.right(c, F.lit(64)))
    return F.concat(F.lit("0x"), F.right(keccak_hex(F.unhex(F.concat(F.lit("ff"), _account(deployer), word(salt), word(code_hash)))), F.lit(40)))


def urls_in(text: Column) -> Column:
    return F.size(urls(F.coalesce(text, F.lit(""))))


def utc_offset(quiet_from: Column, quiet_hours: Column) -> Column:
    """The whole-hour offset at which the middle of a quiet stretch is three at night, from -12 to 11 (half to even)."""
    return (F.pmod(F.bround(3 - (quiet_from + quiet_hours / 2.0)).cast("int") + 12, F.lit(24)) - 12).cast("int")


def offset_band(quiet_hours: Column) -> Column:
    """Hours that the offset may be off on either side; null where that is more than 6, as it says nothing then."""
    band = 2 + F.greatest(F.lit(0), F.bround((quiet_hours - 8) / 2.0).cast("int"))
    return F.when(band <= 6, band)
