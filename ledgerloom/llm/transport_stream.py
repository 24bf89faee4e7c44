"""Media columns as MPEG transport streams (ISO/IEC 13818-1).

`mux` packs bytes into 188-byte packets: program tables (PAT, PMT) before every random-access point, one elementary
stream of timestamped packets (PES), continuity counters and clock references. `demux` reads any such stream back:
it checks the tables' CRC-32, the counters and the sync bytes, reassembles table sections and elementary packets over
as many packets as they take (a packet sent twice counts once), and lists timestamps with random-access points. Damage is counted, never raised: lost packets, bad tables and a stream without
a program give their counts and whatever payload is left.

Defined cases: null or empty bytes mux to a stream with tables and no elementary packet; null media demuxes as empty.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import utf8

#: Fixed by the standard, or the usual choice within it.
PACKET = 188
SYNC = 0x47
PMT_PID = 0x1000
MEDIA_PID = 0x0100
PROGRAM = 1
STREAM_TYPE = 0x06  # private data in PES packets
STREAM_ID = 0xBD
CLOCK = 90_000

_CRC = [0] * 256
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = (_c << 1) ^ (0x04C11DB7 if _c & 0x80000000 else 0)
    _CRC[_i] = _c & 0xFFFFFFFF


def table_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _CRC[crc >> 24 ^ b]
    return crc


def _section(table: int, extension: int, body: bytes) -> bytes:
    """A program table section in a packet's payload, with pointer field and CRC."""
    head = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, extension, 0xC1, 0, 0) + body
    return (b"\x00" + head + struct.pack(">I", table_crc(head))).ljust(PACKET - 4, b"\xff")


_PAT = _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
_PMT = _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | MEDIA_PID, 0xF000, STREAM_TYPE, 0xE000 | MEDIA_PID, 0xF000))


def _stamp(pts: int) -> bytes:
    return struct.pack(">BHH", 0x21 | pts >> 29 & 0x0E, pts >> 14 & 0xFFFE | 1, pts << 1 & 0xFFFE | 1)


def mux(payload: bytes, unit: int = 4608, fps: int = 25, group: int = 8) -> bytes:
    """unit: bytes of each elementary packet; group: elementary packets from one random-access point to the next."""
    out, counter = [], {0: 0, PMT_PID: 0, MEDIA_PID: 0}

    def packet(pid: int, start: bool, body: bytes, adapt: bytes = b"") -> int:
        """Append one packet; returns how much of the body went in. The last packet of a unit is stuffed."""
        room = PACKET - 4 - len(adapt)
        if len(body) < room:
            fill = room - len(body)
            if adapt:
                adapt = bytes([adapt[0] + fill]) + adapt[1:] + b"\xff" * fill
            else:
                adapt = b"\x00" if fill == 1 else bytes([fill - 1, 0]) + b"\xff" * (fill - 2)
            room = len(body)
        out.append(struct.pack(">BHB", SYNC, start << 14 | pid, (0x30 if adapt else 0x10) | counter[pid]) + adapt + body[:room])
        counter[pid] = counter[pid] + 1 & 15
        return room

    for k, at in enumerate(range(0, max(len(payload), 1), unit)):
        clock = k * CLOCK // fps
        if k % group == 0:
            packet(0, True, _PAT)
            packet(PMT_PID, True, _PMT)
        data = payload[at : at + unit]
        if not data:
            break
        pes = b"\x00\x00\x01" + struct.pack(">BHBBB", STREAM_ID, len(data) + 8, 0x84, 0x80, 5) + _stamp(clock + CLOCK) + data
        adapt = bytes([7, 0x50]) + (clock << 15 | 0x7E00).to_bytes(6, "big") if k % group == 0 else b""
        used = packet(MEDIA_PID, True, pes, adapt)
        while used < len(pes):
            used += packet(MEDIA_PID, False, pes[used : used + PACKET - 4])
    return b"".join(out)


@dataclass
class Demuxed:
    payload: bytes = b""
    packets: int = 0
    lost_sync: int = 0
    counter_errors: int = 0
    bad_tables: int = 0
    programs: int = 0
    pts: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)  # indexes into pts

    def timestamps(self) -> list[dict]:
        points = set(self.random_access)
        return [{"pts": p, "random": i in points} for i, p in enumerate(self.pts)]


def _sections(parts: list[tuple[bool, bytes]]) -> tuple[list[bytes], int]:
    """(intact sections without their CRC, damaged ones) of a table's packets (starts a section, payload) in order. A
    section may go on over packets, and a packet may end one and start others."""
    good, bad, held, open_ = [], 0, b"", False

    def take() -> None:
        nonlocal bad, held, open_
        while len(held) >= 3 and held[0] != 0xFF:  # 0xFF is stuffing
            n = 3 + (int.from_bytes(held[1:3], "big") & 0x0FFF)
            if len(held) < n:
                return
            if n >= 12 and table_crc(held[:n]) == 0:
                good.append(held[: n - 4])
            else:
                bad += 1
            held = held[n:]
        open_ = 0 < len(held) < 3 and held[0] != 0xFF

    for starts, data in parts:
        if starts and data:
            at = 1 + data[0]
            if open_:
                held += data[1:at]
                take()
                bad += open_
            held, open_ = data[at:], True
            take()
        elif open_:
            held += data
            take()
    return good, bad + (open_ and bool(held))


def demux(media: bytes | None) -> Demuxed:
    found = Demuxed()
    if not media or len(media) < PACKET:
        found.lost_sync = int(bool(media))
        return found
    rows = np.frombuffer(media, dtype=np.uint8)[: len(media) // PACKET * PACKET].reshape(-1, PACKET)
    good = rows[:, 0] == SYNC
    found.packets, found.lost_sync = len(rows), int((~good).sum()) + (len(media) % PACKET > 0)
    rows = rows[good]
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    start, control, counter = rows[:, 1] & 0x40 != 0, rows[:, 3] >> 4 & 3, rows[:, 3] & 15
    adapted = control & 2 != 0
    begin = np.where(adapted, 5 + rows[:, 4].astype(np.int32), 4)
    carries = (control & 1 != 0) & (begin <= PACKET)
    flags = np.where(adapted & (rows[:, 4] > 0), rows[:, 5], 0)

    columns = np.arange(PACKET)
    repeats = np.zeros(len(rows), dtype=bool)
    for of in np.unique(pid[carries]):  # a packet may come twice in a row: the second carries nothing new
        own = np.flatnonzero((pid == of) & carries)
        a, b = own[:-1], own[1:]
        same = ((rows[a] == rows[b]) | (columns < begin[b][:, None])).all(axis=1) & (begin[a] == begin[b]) & (counter[a] == counter[b])
        same[1:] &= ~same[:-1]
        repeats[b[same]] = True
    carries = carries & ~repeats

    def tables(of: int) -> list[bytes]:
        good, bad = _sections([(bool(start[i]), rows[i, begin[i] :].tobytes()) for i in np.flatnonzero((pid == of) & carries)])
        found.bad_tables += bad
        return list(dict.fromkeys(good))

    maps = {}
    for pat in tables(0):
        maps.update({int.from_bytes(pat[k + 2 : k + 4], "big") & 0x1FFF: int.from_bytes(pat[k : k + 2], "big") for k in range(8, len(pat) - 3, 4)})
    maps = {k: v for k, v in maps.items() if v}  # program 0 is the network's table
    found.programs = len(maps)
    streams: list[int] = []
    for of in sorted(maps):
        for pmt in tables(of):
            at = 12 + (int.from_bytes(pmt[10:12], "big") & 0x0FFF)
            while at + 5 <= len(pmt):
                streams.append(int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF)
                at += 5 + (int.from_bytes(pmt[at + 3 : at + 5], "big") & 0x0FFF)
    pieces = []
    for of in [0, *sorted(maps), *dict.fromkeys(streams)]:
        own = np.flatnonzero((pid == of) & carries)
        step = np.diff(counter[own].astype(np.int8)) & 15
        marked = flags[own][1:] & 0x80 != 0  # a discontinuity that the stream announces
        found.counter_errors += int(((step != 1) & ~marked).sum())
        if of not in streams or not len(own):
            continue
        first = np.flatnonzero(start[own])
        for a, b in zip(first, [*first[1:], len(own)], strict=True):
            part = own[a:b]
            pes = rows[part][columns >= begin[part][:, None]].tobytes()
            if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
                found.bad_tables += 1
                continue
            if pes[7] & 0x80 and len(pes) >= 14:
                if flags[own[a]] & 0x40:
                    found.random_access.append(len(found.pts))
                p = pes[9:14]
                found.pts.append((p[0] & 0x0E) << 29 | p[1] << 22 | (p[2] & 0xFE) << 14 | p[3] << 7 | p[4] >> 1)
            length = int.from_bytes(pes[4:6], "big")
            pieces.append(pes[9 + pes[8] : 6 + length if length else None])
    found.payload = b"".join(pieces)
    return found


def mux_column(payload: Column) -> Column:
    """A binary column stored as transport streams."""
    return F.pandas_udf(lambda s: s.map(lambda x: mux(bytes(x) if x is not None else b"")), "binary")(payload)


DEMUXED = "payload binary, packets long, lost_sync long, counter_errors long, bad_tables long, programs long, pts array<long>, random_access array<long>"


def demux_column(media: Column) -> Column:
    """A struct of what each stream holds: payload, counts of damage, timestamps, indexes of random-access points."""

    def read(streams: pd.Series) -> pd.DataFrame:
        each = [demux(bytes(x) if x is not None else None) for x in streams]
        return pd.DataFrame({k: [getattr(x, k) for x in each] for k in Demuxed.__dataclass_fields__})

    return F.pandas_udf(read, DEMUXED)(media)


def padded(text: str | None, multiple: int = 576) -> bytes:
    """The text as UTF-8 and bytes 255 up to a positive multiple; null is empty."""
    data = utf8(text)
    return data + b"\xff" * (max(1, -(-len(data) // multiple)) * multiple - len(data))


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, timestamps array<struct<pts:long,random:boolean>>"


def text_media(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", multiple: int = 576) -> DataFrame:
    """Every text stored as a media column: (doc_id, n_bytes, media)."""

    def store(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), 256):  # bounds what is held besides the batch itself
                part = pdf.iloc[at : at + 256]
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_bytes": [len(utf8(x)) for x in part["text"]], "media": [mux(padded(x, multiple)) for x in part["text"]]})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(store, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Read stored media back, one row per stream: digests of payload and stream, and its timestamps, each with whether
    it is a random-access point."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for doc_id, n, raw in zip(pdf["doc_id"], pdf["n_bytes"], pdf["media"], strict=True):
                raw = bytes(raw) if raw is not None else b""
                x = demux(raw)
                feature = f"packets={x.packets} programs={x.programs} units={len(x.pts)} random={len(x.random_access)} span={x.pts[-1] - x.pts[0] if x.pts else 0} errors={x.counter_errors + x.lost_sync + x.bad_tables}"
                rows.append((doc_id, n, len(x.payload), hashlib.sha256(x.payload).hexdigest(), zlib.crc32(x.payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, x.timestamps()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")]).astype({"doc_id": "Int64"})

    return media.mapInPandas(read, FEATURES)


def random_access_points(features: DataFrame) -> DataFrame:
    """(doc_id, unit, pts): where decoding can start, one row a point, for seeks and joins by time."""
    each = features.select("doc_id", F.posexplode("timestamps").alias("unit", "at"))
    return each.where("at.random").select("doc_id", "unit", "at.pts")
