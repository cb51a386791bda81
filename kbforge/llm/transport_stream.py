"""Operator 5, media columns: MPEG transport streams (ISO/IEC 13818-1) as a binary column.

`mux` stores a payload as access units, one PES packet each with a presentation time stamp, on one elementary stream
whose program tables (PAT, PMT) come first and again before every TABLE_EVERY-th unit; every unit starts with a
random-access point. `demux` parses the stored bytes: program tables with their CRC, continuity counters of every PID,
PES reassembly, time stamps and random-access points.

Null or empty text counts as empty: its payload is one block of padding. Equal texts give equal values, repeated rows and
ties included; extra columns are ignored; an empty table gives an empty table. A document is muxed in one row, whatever
its length. A stream that lacks packets is still read: gaps are counted, units that lack bytes are named, what follows is kept.
A packet that is sent twice in a row, as the standard allows, counts once. Table sections may span packets. A null doc_id stays null.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kbforge.llm import kernel

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, ES_PID, PROGRAM, STREAM_TYPE, STREAM_ID = 0, 0x100, 0x101, 1, 0x06, 0xBD
#: Bytes of payload in an access unit, ticks of the 90 kHz clock between units, units between program tables.
UNIT, TICKS, TABLE_EVERY = 4608, 3600, 16
BLOCK, PAD = 576, b"\xff"
PTS_MOD = 1 << 33


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32/MPEG-2; 0 over a section with its own CRC."""
    c = 0xFFFFFFFF
    for x in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ x]
    return c


def _section(table_id: int, ext: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + ext.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _head(pid: int, start: bool, kind: int, counter: int) -> bytes:
    return bytes([SYNC, (0x40 if start else 0) | pid >> 8, pid & 255, kind << 4 | counter])


_PAT = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = _section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
_TABLES = [
    b"".join(_head(pid, True, 1, c) + (b"\0" + s).ljust(PACKET - 4, b"\xff") for pid, s in ((PAT_PID, _PAT), (PMT_PID, _PMT))) for c in range(16)
]
_PLAIN = [_head(ES_PID, False, 1, c) for c in range(16)]
_FIRST = [_head(ES_PID, True, 3, c) for c in range(16)]
_LAST = [_head(ES_PID, False, 3, c) for c in range(16)]


def _stamp(tag: int, pts: int) -> bytes:
    return bytes([tag << 4 | (pts >> 30 & 7) << 1 | 1, pts >> 22 & 255, (pts >> 15 & 127) << 1 | 1, pts >> 7 & 255, (pts & 127) << 1 | 1])


def mux(payload: bytes) -> bytes:
    out: list[bytes] = []
    counter = tables = 0
    room = PACKET - 4
    for i, at in enumerate(range(0, len(payload), UNIT)):
        if i % TABLE_EVERY == 0:
            out.append(_TABLES[tables])
            tables = (tables + 1) & 15
        unit, pts = payload[at : at + UNIT], i * TICKS % PTS_MOD
        pes = b"\0\0\1" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, pts) + unit
        clock = (pts << 15 | 0x7E00).to_bytes(6, "big")
        field = b"\x50" + clock  # random access, clock reference
        take = room - 1 - len(field)
        if len(pes) < take:
            field += b"\xff" * (take - len(pes))
        out += (_FIRST[counter], bytes([len(field)]), field, pes[:take])
        counter = (counter + 1) & 15
        full = max(0, len(pes) - take) // room
        for k in range(take, take + full * room, room):
            out += (_PLAIN[counter], pes[k : k + room])
            counter = (counter + 1) & 15
        rest = pes[take + full * room :]
        if rest:
            gap = room - len(rest)
            out += (_LAST[counter], bytes([gap - 1]), b"\0" * (gap > 1) + b"\xff" * (gap - 2), rest)
            counter = (counter + 1) & 15
    return b"".join(out)


@dataclass
class Stream:
    packets: int
    lost_sync: int
    program: int | None
    pmt_pid: int | None
    es_pid: int | None
    bad_tables: int
    gaps: int
    repeated: int  # packets that came twice in a row
    broken: list[int]  # units that lack bytes
    units: list[tuple[int | None, bool, bytes]]  # time stamp, random access, payload


def _sections(rows: np.ndarray, begin: np.ndarray, start: np.ndarray) -> Iterator[bytes]:
    """Sections of the packets of one PID, put together where they span packets. What is cut off by a start is given as it is."""
    held = b""
    for row, at, first in zip(rows, begin, start):
        data = row.tobytes()[at:]
        if first and data:
            held += data[1 : 1 + data[0]]
            yield from _cut(held)[0]
            if _cut(held)[1]:
                yield _cut(held)[1]
            held = data[1 + data[0] :]
        elif held:
            held += data
        done, held = _cut(held)
        yield from done
    if held:
        yield held


def _cut(data: bytes) -> tuple[list[bytes], bytes]:
    """Whole sections and what is left of one; stuffing ends the data."""
    out = []
    while len(data) >= 3 and data[0] != 0xFF:
        size = 3 + ((data[1] & 15) << 8 | data[2])
        if len(data) < size:
            return out, data
        out.append(data[:size])
        data = data[size:]
    return out, b"" if data[:1] in (b"\xff", b"") else data


def _aligned(media: bytes) -> tuple[np.ndarray, int]:
    """Packets as rows; bytes that had to be skipped to find the sync byte again."""
    whole = np.frombuffer(media, np.uint8, len(media) // PACKET * PACKET).reshape(-1, PACKET)
    if len(whole) * PACKET == len(media) and (whole[:, 0] == SYNC).all():
        return whole, 0
    rows, at, lost = [], 0, 0
    while at + PACKET <= len(media):
        if media[at] == SYNC and (at + PACKET == len(media) or media[at + PACKET : at + PACKET + 1] in (b"G", b"")):
            rows.append(media[at : at + PACKET])
            at += PACKET
        else:
            at, lost = at + 1, lost + 1
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, PACKET), lost + len(media) - at


def demux(media: bytes) -> Stream:
    rows, lost = _aligned(media)
    pid = (rows[:, 1].astype(np.int32) & 31) << 8 | rows[:, 2]
    start, kind, counter = (rows[:, 1] & 64) > 0, rows[:, 3] >> 4 & 3, rows[:, 3] & 15
    begin = np.where(kind & 2, 5 + rows[:, 4].astype(np.int32), 4)
    begin = np.where(kind & 1, np.minimum(begin, PACKET), PACKET)
    access = (kind & 2 > 0) & (rows[:, 4] > 0) & (rows[:, 5] & 64 > 0)
    gaps = 0
    again = np.zeros(len(rows), bool)
    for p in np.unique(pid):
        at = np.flatnonzero((pid == p) & (kind & 1 > 0))
        step = np.diff(counter[at].astype(np.int32)) % 16
        still = np.flatnonzero(step == 0)
        twice = still[(rows[at[still]] == rows[at[still + 1]]).all(1)]
        again[at[twice + 1]] = True
        gaps += int((step != 1).sum()) - len(twice)
    if again.any():
        stays = ~again
        rows, pid, start, kind, counter, begin, access = rows[stays], pid[stays], start[stays], kind[stays], counter[stays], begin[stays], access[stays]
    bad, program, pmt_pid, es_pid = 0, None, None, None
    for s in dict.fromkeys(_sections(*(x[pid == PAT_PID] for x in (rows, begin, start)))):
        if section_crc(s) or len(s) < 16:
            bad += 1
        else:
            program, pmt_pid = s[8] << 8 | s[9], (s[10] & 31) << 8 | s[11]
    if pmt_pid is not None:
        for s in dict.fromkeys(_sections(*(x[pid == pmt_pid] for x in (rows, begin, start)))):
            if section_crc(s) or len(s) < 21:
                bad += 1
            else:
                at = 12 + ((s[10] & 15) << 8 | s[11])
                es_pid = (s[at + 1] & 31) << 8 | s[at + 2]
    units: list[tuple[int | None, bool, bytes]] = []
    broken: list[int] = []
    if es_pid is not None:
        own = pid == es_pid
        mine, begin, start, access = rows[own], begin[own], start[own], access[own]
        flat = mine[np.arange(PACKET) >= begin[:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(PACKET - begin)])
        heads = np.flatnonzero(start)
        for a, b in zip(heads, [*heads[1:], len(mine)]):
            pes = flat[ends[a] : ends[b]]
            if pes[:3] != b"\0\0\1" or len(pes) < 9:
                bad += 1
                continue
            pts = None
            if pes[7] & 0x80:
                x = pes[9:14]
                pts = (x[0] >> 1 & 7) << 30 | x[1] << 22 | (x[2] >> 1) << 15 | x[3] << 7 | x[4] >> 1
            long = pes[4] << 8 | pes[5]
            if long and len(pes) < 6 + long:
                broken.append(len(units))
            units.append((pts, bool(access[a]), pes[9 + pes[8] : 6 + long if long else None]))
    return Stream(len(rows) + int(again.sum()), lost, program, pmt_pid, es_pid, bad, gaps, int(again.sum()), broken, units)


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    return data + PAD * (max(1, -(-len(data) // BLOCK)) * BLOCK - len(data)), len(data)


def with_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, media): the stored form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _parts(batch):
                made = [payload_of(t) for t in texts]
                yield pa.RecordBatch.from_arrays([ids, pa.array([n for _, n in made], pa.int64()), pa.array([mux(p) for p, _ in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str | None]]]:
    for a, b in kernel.pieces(batch.column(1)):
        yield batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a).to_pylist()


def features(stored: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, media) to what a demultiplexer reads from them, with time stamps and random-access points."""
    schema = (
        "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, "
        "timestamps array<bigint>, random_access array<bigint>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for a, b in kernel.pieces(batch.column(2)):
                part, rows = batch.slice(a, b - a), []
                for doc, n, media in zip(*(part.column(i).to_pylist() for i in range(3))):
                    s = demux(media)
                    payload = b"".join(u for _, _, u in s.units)
                    stamps = [p for p, _, _ in s.units if p is not None]
                    points = [i for i, (_, r, _) in enumerate(s.units) if r]
                    feature = f"program={s.program};pmt={s.pmt_pid};es={s.es_pid};packets={s.packets};units={len(s.units)};access={len(points)};first_pts={stamps[0] if stamps else -1};last_pts={stamps[-1] if stamps else -1};gaps={s.gaps};repeated={s.repeated};broken={len(s.broken)};bad={s.bad_tables};lost={s.lost_sync}"
                    rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, stamps, points))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names)

    return stored.mapInArrow(run, schema)


_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def op5(docs: DataFrame) -> DataFrame:
    return features(with_media(docs))
