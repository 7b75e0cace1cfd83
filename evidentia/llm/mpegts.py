"""Media columns as MPEG transport streams (ISO/IEC 13818-1): write, parse, check, index.

A payload becomes one private data stream: access units of UNIT bytes, one PES packet each with a
presentation timestamp, cut into 188-byte packets after a program association table and a program
map table. Every PES starts in a packet with a clock reference; every KEY-th is a random-access point. Reading parses the
tables (with their checksums), checks the continuity counter of every packet, reassembles the
PES packets and returns the samples with timestamps and random-access points. What is lost or damaged is counted and left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: packet size, sync byte, table ids, stream type and id of private data.
PACKET, SYNC, PAT_ID, PMT_ID, PRIVATE_TYPE, PRIVATE_ID = 188, 0x47, 0, 2, 6, 0xBD
#: Ours: the map's and the stream's PIDs, program number, bytes in an access unit, ticks of 90 kHz between units, units between random-access points.
MAP_PID, DATA_PID, PROGRAM, UNIT, TICKS, KEY = 0x100, 0x101, 1, 576 * 8, 3600, 8
FRAME = 576
#: Bytes before the samples of a PES packet (start code, id, length, flags, 5-byte timestamp).
PES_HEAD = 14


class Stream(NamedTuple):
    """What reading a stream gives; offsets are bytes into the samples, timestamps 90 kHz ticks.

    samples, timestamps and random-access points are those of the units that arrived whole; damaged counts the others.
    discontinuities are places where the continuity counter jumps, lost the packets that are missing there at least,
    repeated packets sent twice, which the format allows, unsynced bytes that belong to no packet.
    """

    samples: bytes
    packets: int
    units: int
    programs: int
    discontinuities: int
    lost: int
    repeated: int
    damaged: int
    unsynced: int
    timestamps: list[int]
    random_access: list[int]


@lru_cache(maxsize=1024)
def _crc32(section: bytes) -> int:
    """The format's checksum: polynomial 0x04C11DB7, most significant bit first, start all ones, no final inversion."""
    crc = 0xFFFFFFFF
    for byte in section:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _section_packet(pid: int, table: int, number: int, body: bytes) -> bytes:
    section = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0" + body
    section += _crc32(section).to_bytes(4, "big")
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return packet.ljust(PACKET, b"\xff")


@lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    pat = _section_packet(0, PAT_ID, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | MAP_PID).to_bytes(2, "big"))
    body = (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0"
    return np.frombuffer(pat + _section_packet(MAP_PID, PMT_ID, PROGRAM, body), np.uint8).reshape(2, PACKET)


def _unit_packets(units: np.ndarray, first: int, counter: int) -> np.ndarray:
    """Packets of PES packets with equally long samples, one row of `units` each; first: number of the first unit."""
    n, length = units.shape
    room = PACKET - 4 - 8  # the first packet has an 8-byte adaptation field: flags and clock
    body = PES_HEAD + length
    rest = max(0, body - room)
    m = 1 + -(-rest // (PACKET - 4))
    out = np.full((n, m, PACKET), 255, np.uint8)
    number = first + np.arange(n, dtype=np.int64)
    pts = number * TICKS & (1 << 33) - 1
    out[:, :, 0], out[:, :, 1], out[:, :, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
    out[:, 0, 1] |= 0x40
    out[:, :, 3] = 0x10 | (counter + np.arange(n * m).reshape(n, m)) & 15
    head = np.zeros((n, 8 + PES_HEAD), np.uint8)
    head[:, 0] = 7
    head[:, 1] = np.where(number % KEY == 0, 0x50, 0x10)
    for i, shift in enumerate((25, 17, 9, 1)):
        head[:, 2 + i] = pts >> shift & 255
    head[:, 6] = (pts & 1) << 7 | 0x7E
    head[:, 8:15] = [0, 0, 1, PRIVATE_ID, (length + 8) >> 8, (length + 8) & 255, 0x84]
    head[:, 15], head[:, 16] = 0x80, 5
    head[:, 17] = 0x21 | (pts >> 30 & 7) << 1
    head[:, 18] = pts >> 22 & 255
    head[:, 19] = (pts >> 15 & 127) << 1 | 1
    head[:, 20] = pts >> 7 & 255
    head[:, 21] = (pts & 127) << 1 | 1
    at = 4 + 8 + PES_HEAD
    if m == 1:
        fill = room - body
        out[:, 0, 3] |= 0x20
        out[:, 0, 4 : 4 + 8] = head[:, :8]
        out[:, 0, 4] = 7 + fill
        out[:, 0, 12 + fill : 12 + fill + PES_HEAD] = head[:, 8:]
        out[:, 0, 12 + fill + PES_HEAD :] = units
        return out.reshape(-1, PACKET)
    out[:, 0, 3] |= 0x20
    out[:, 0, 4:at] = head
    taken = PACKET - at
    out[:, 0, at:] = units[:, :taken]
    whole = m - 2
    out[:, 1 : 1 + whole, 4:] = units[:, taken : taken + whole * 184].reshape(n, whole, 184)
    tail = units[:, taken + whole * 184 :]
    if fill := 184 - tail.shape[1]:
        out[:, -1, 3] |= 0x20
        out[:, -1, 4] = fill - 1
        if fill > 1:
            out[:, -1, 5] = 0
    out[:, -1, 4 + fill :] = tail
    return out.reshape(-1, PACKET)


def mux(samples: bytes) -> bytes:
    """A transport stream that holds `samples`."""
    data = np.frombuffer(samples, np.uint8)
    whole = len(data) // UNIT
    parts, counter = [_tables()], 0
    if whole:
        parts.append(_unit_packets(data[: whole * UNIT].reshape(whole, UNIT), 0, 0))
        counter = len(parts[-1])
    if len(data) > whole * UNIT:
        parts.append(_unit_packets(data[whole * UNIT :][None, :], whole, counter))
    return np.concatenate(parts).tobytes()


def _sections(packets: np.ndarray, table: int) -> list[bytes]:
    """Bodies of the tables that start in these packets, whose checksums hold."""
    found = []
    for p in packets[packets[:, 1] & 0x40 > 0]:
        raw = p.tobytes()[4:]
        if p[3] & 0x20:
            raw = raw[1 + raw[0] :]
        raw = raw[1 + raw[0] :] if raw else raw  # an adaptation field may leave no room
        size = 3 + (int.from_bytes(raw[1:3], "big") & 0xFFF)
        if len(raw) > 2 and raw[0] == table and 12 <= size <= len(raw) and _crc32(raw[: size - 4]) == int.from_bytes(raw[size - 4 : size], "big"):
            found.append(raw[8 : size - 4])
    return found


def _data_pid(p: np.ndarray, pid: np.ndarray) -> tuple[int, int | None]:
    """(number of programs, PID of the first private data stream that a program map names, if any)."""
    programs = {}
    for body in _sections(p[pid == 0], PAT_ID):
        for i in range(0, len(body), 4):
            programs[int.from_bytes(body[i : i + 2], "big")] = int.from_bytes(body[i + 2 : i + 4], "big") & 0x1FFF
    streams = []
    for map_pid in programs.values():
        for body in _sections(p[pid == map_pid], PMT_ID):
            at = 4 + (int.from_bytes(body[2:4], "big") & 0xFFF)
            while at < len(body):
                streams.append((body[at], int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF))
                at += 5 + (int.from_bytes(body[at + 3 : at + 5], "big") & 0xFFF)
    return len(programs), next((s for kind, s in streams if kind == PRIVATE_TYPE), None)


def _packets(stream: bytes) -> np.ndarray:
    """The stream's packets, one a row. Where a sync byte is missing, reading goes on at the next place from which two packets are in step."""
    whole = len(stream) // PACKET * PACKET
    p = np.frombuffer(stream[:whole], np.uint8).reshape(-1, PACKET)
    if whole == len(stream) and (p[:, 0] == SYNC).all():
        return p
    rows, at, in_step = [], 0, True
    while at + PACKET <= len(stream):
        if stream[at] == SYNC and (in_step or at + PACKET == len(stream) or stream[at + PACKET] == SYNC):
            rows.append(stream[at : at + PACKET])
            at, in_step = at + PACKET, True
        else:
            at, in_step = stream.find(SYNC, at + 1), False
            if at < 0:
                break
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, PACKET)


def demux(stream: bytes) -> Stream:
    """Read a stream. Damage is counted, never raised: a unit with a missing packet or a wrong head is left out, and a
    stream without readable tables gives no units."""
    p = _packets(stream)
    unsynced = len(stream) - p.size
    pid = (p[:, 1] & 0x1F).astype(np.int32) << 8 | p[:, 2]
    programs, data = _data_pid(p, pid)
    d = p[pid == data] if data is not None else p[:0]
    d = d[d[:, 3] & 0x10 > 0]  # packets without a payload don't count
    again = np.zeros(len(d), bool)
    again[1:] = (d[1:] == d[:-1]).all(1)
    d = d[~again]
    step = (d[1:, 3].astype(np.int32) - d[:-1, 3]) & 15
    gap = np.concatenate(([False], step != 1)) if len(d) else np.zeros(0, bool)
    lost = int(((step - 1) & 15).sum())
    field = d[:, 3] & 0x20 > 0
    size = np.where(field, d[:, 4].astype(np.int32) + 1, 0)
    starts = 4 + size
    new = (d[:, 1] & 0x40 > 0) & (starts + PES_HEAD <= PACKET)
    unit = np.cumsum(new) - 1
    heads = d[new]
    head = heads[np.arange(len(heads))[:, None], starts[new][:, None] + np.arange(PES_HEAD)].astype(np.int64).reshape(-1, PES_HEAD)
    pts = (head[:, 9] >> 1 & 7) << 30 | head[:, 10] << 22 | head[:, 11] >> 1 << 15 | head[:, 12] << 7 | head[:, 13] >> 1
    length = (head[:, 4] << 8 | head[:, 5]) - 3 - head[:, 8]
    skip = starts.copy()
    skip[new] += 9 + head[:, 8].astype(np.int32)
    carried = np.bincount(unit[unit >= 0], np.maximum(PACKET - skip, 0)[unit >= 0], minlength=len(head)).astype(np.int64)
    good = (head[:, :4] == [0, 0, 1, PRIVATE_ID]).all(1) & (carried == length)
    good[np.unique(unit[gap & ~new & (unit >= 0)])] = False
    orphans = int((unit < 0).any())
    in_good = np.zeros(len(d), bool)
    in_good[unit >= 0] = good[unit[unit >= 0]]
    keep = (np.arange(PACKET)[None, :] >= skip[:, None]) & in_good[:, None]
    key = (field & (size > 1) & (d[:, 5] & 0x40 > 0))[new]
    offsets = np.concatenate(([0], np.cumsum(length[good])))
    return Stream(d[keep].tobytes(), len(p), int(good.sum()), programs, int(gap.sum()), lost, int(again.sum()), int((~good).sum()) + orphans, unsynced, pts[good].tolist(), offsets[:-1][key[good]].tolist())


def payload_of(text: str | None) -> bytes:
    """UTF-8, then bytes 255 up to a positive multiple of FRAME."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(FRAME, -(-len(raw) // FRAME) * FRAME), b"\xff")


def media(payload: Column | str) -> Column:
    """A binary column stored as transport streams; null is stored as an empty payload of one frame."""

    @F.pandas_udf("binary")
    def store(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in blocks:
            yield pd.Series([mux(payload_of(None) if x is None else bytes(x)) for x in s], dtype=object)

    return store(payload)


def media_of_text(text: Column | str) -> Column:
    """The padded UTF-8 of a text column stored as transport streams; null counts as empty."""

    @F.pandas_udf("binary")
    def store(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in blocks:
            yield pd.Series([mux(payload_of(x)) for x in s], dtype=object)

    return store(text)


_READ = "payload binary, packets int, units int, programs int, discontinuities int, lost int, repeated int, damaged int, unsynced int, timestamps array<long>, random_access array<long>"
_DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, timestamps array<long>, random_access array<long>"


def read(stream: Column | str) -> Column:
    """struct of the stored payload, counts of packets, units and damage, timestamps and random-access points of a media column; a null cell reads as an empty stream."""

    @F.pandas_udf(_READ)
    def parse(blocks: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in blocks:
            yield pd.DataFrame([demux(b"" if x is None else bytes(x))._asdict() for x in s], columns=list(Stream._fields)).rename(columns={"samples": "payload"})

    return parse(stream)


def feature_of(s: Stream, payload: np.ndarray) -> str:
    """One line on a stream: its packets, units, lost packets, span of timestamps, random-access points, and its samples' mean and spread."""
    seek = zlib.crc32(np.array([*s.timestamps, *s.random_access], "<i8").tobytes())
    return f"ts packets={s.packets} units={s.units} programs={s.programs} lost={s.lost} damaged={s.damaged} pts={min(s.timestamps, default=0)}-{max(s.timestamps, default=0)} raps={len(s.random_access)} index={seek:08x} mean={payload.mean() if len(payload) else 0:.4f} std={payload.std() if len(payload) else 0:.4f}"


def digests(stream: Column | str) -> Column:
    """struct of digests and features of a media column, from the stored bytes alone."""

    @F.pandas_udf(_DIGEST)
    def digest(blocks: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in blocks:
            rows = []
            for x in s:
                raw = b"" if x is None else bytes(x)
                got = demux(raw)
                rows.append((len(got.samples), hashlib.sha256(got.samples).hexdigest(), zlib.crc32(got.samples[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature_of(got, np.frombuffer(got.samples, np.uint8)), got.timestamps, got.random_access))
            yield pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "timestamps", "random_access"])

    return digest(stream)


def op9(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, and digests, timestamps and random-access points of every text stored as a stream and read back.

    Null and empty texts store one frame of padding; repeated rows and null ids stay; equal texts give equal values;
    other columns are ignored; an empty table gives an empty result. Texts of any length are stored whole.
    """
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), digests(media_of_text(text)).alias("d")).select("doc_id", "n_bytes", "d.*")
