"""Media columns in MPEG transport streams.

:func:`mux` stores a payload of 8-bit samples losslessly: program tables (PAT, PMT) first and again after every
TABLES_EVERY units, then elementary packets of UNIT bytes with a presentation time stamp, cut into packets of 188
bytes with continuity counters; every unit starts with a clock reference and a random-access mark. :func:`demux` reads
any such stream back: it parses program tables (checking their CRC), checks continuity counters, reassembles
elementary packets, and lists time stamps (presentation, decoding, clock) and random-access points. Where the stream
loses step (bytes lost or added), it goes on at the next place from which sync bytes follow at the right distance.
Program tables may span packets, and a packet may hold several.

Cases: a null payload has null media; an empty payload is a stream of tables alone; media that is null or not a stream
parses to no streams with its faults counted; lost, repeated or damaged packets are counted, and what can be
reassembled is returned; columns other than the named ones pass through; equal payloads give equal media.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format: sizes, marks, packet ids and clock.
PACKET, SYNC, PAT_PID, PMT_PID, DATA_PID, NULL_PID, CLOCK = 188, 0x47, 0x0000, 0x1000, 0x0100, 0x1FFF, 90_000
PRIVATE_STREAM, PRIVATE_TYPE = 0xBD, 0x06
#: Bytes of a unit, samples a second, and units between program tables.
UNIT, RATE, TABLES_EVERY = 3072, 8000, 64


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else c << 1
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def section(table_id: int, number: int, body: bytes) -> bytes:
    """A program-table section with its length and CRC."""
    length = len(body) + 9
    head = bytes([table_id, 0xB0 | length >> 8, length & 255, number >> 8, number & 255, 0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def time_stamp(mark: int, t: int) -> bytes:
    t &= (1 << 33) - 1
    return bytes([mark << 4 | (t >> 30) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])


_PAT = section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")


def _table_packet(pid: int, counter: int, sec: bytes) -> bytes:
    return bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | counter & 15, 0]) + sec + b"\xff" * (PACKET - 5 - len(sec))


def mux(payload: bytes) -> bytes:
    """A transport stream of one program with one private stream."""
    out, tables, counter = [], 0, 0
    for k, lo in enumerate(range(0, max(1, len(payload)), UNIT)):
        if k % TABLES_EVERY == 0:
            out += [_table_packet(PAT_PID, tables, _PAT), _table_packet(PMT_PID, tables, _PMT)]
            tables += 1
        part = payload[lo : lo + UNIT]
        if not part:
            break
        t = lo * CLOCK // RATE
        data = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(part) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + time_stamp(2, t) + part
        base = t & (1 << 33) - 1
        clock = bytes([base >> 25 & 255, base >> 17 & 255, base >> 9 & 255, base >> 1 & 255, (base & 1) << 7 | 0x7E, 0])
        room = PACKET - 12
        if len(data) <= room:
            pad = room - len(data)
            out.append(bytes([SYNC, 0x40 | DATA_PID >> 8, DATA_PID & 255, 0x30 | counter & 15, 7 + pad, 0x50]) + clock + b"\xff" * pad + data)
            counter += 1
            continue
        out.append(bytes([SYNC, 0x40 | DATA_PID >> 8, DATA_PID & 255, 0x30 | counter & 15, 7, 0x50]) + clock + data[:room])
        counter += 1
        at, end = room, len(data)
        while end - at >= 184:
            out.append(bytes((SYNC, DATA_PID >> 8, DATA_PID & 255, 0x10 | counter & 15)) + data[at : at + 184])
            counter += 1
            at += 184
        if at < end:
            pad = 183 - (end - at)  # bytes of the adaptation field after its length
            field_ = bytes([pad]) + (b"\x00" + b"\xff" * (pad - 1) if pad else b"")
            out.append(bytes((SYNC, DATA_PID >> 8, DATA_PID & 255, 0x30 | counter & 15)) + field_ + data[at:])
            counter += 1
    return b"".join(out)


def read_stamp(a: bytes) -> int:
    return (a[0] >> 1 & 7) << 30 | a[1] << 22 | a[2] >> 1 << 15 | a[3] << 7 | a[4] >> 1


@dataclass
class Stream:
    """What is read of one elementary stream."""

    pid: int
    kind: int = 0
    units: list[tuple[int | None, bool, int, int | None, int | None]] = field(default_factory=list)
    parts: list[bytes] = field(default_factory=list)
    open_: list[bytes] = field(default_factory=list)
    rap: bool = False
    clock: int | None = None

    def close(self) -> int:
        """Take in the elementary packet that is open; 1 if it is damaged."""
        data, self.open_ = b"".join(self.open_), []
        if not data:
            return 0
        if data[:3] != b"\x00\x00\x01" or len(data) < 9 or len(data) < 9 + data[8]:
            return 1
        told, start = int.from_bytes(data[4:6], "big"), 9 + data[8]
        stop = 6 + told if told else len(data)
        pts = read_stamp(data[9:14]) if data[7] & 0x80 and data[8] >= 5 else None
        dts = read_stamp(data[14:19]) if data[7] & 0xC0 == 0xC0 and data[8] >= 10 else None
        part = data[start:stop]
        self.units.append((pts, self.rap, len(part), dts, self.clock))
        self.parts.append(part)
        return int(stop > len(data))


@dataclass
class Parsed:
    """All of a stream: programs (number, table's packet id), streams, and counts of faults."""

    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, Stream] = field(default_factory=dict)
    packets: int = 0
    counter_faults: int = 0
    table_faults: int = 0
    damaged: int = 0


def in_step(media: bytes, at: int) -> int:
    """The next place from which sync bytes follow at the distance of packets, as far as two packets on; the end if there is none."""
    while (at := media.find(b"\x47", at)) >= 0:
        if all(media[k] == SYNC for k in range(at + PACKET, min(at + 2 * PACKET + 1, len(media)), PACKET)):
            return at
        at += 1
    return len(media)


class Tables:
    """Sections of program tables as they come in over packets."""

    def __init__(self, out: Parsed):
        self.out, self.seen, self.open = out, {PAT_PID: b""}, {}

    def take(self, pid: int, start: bool, body: bytes, broken: bool) -> None:
        """The body of a packet of a table; ``broken`` if packets before it are missing."""
        if broken and self.open.pop(pid, b""):
            self.out.table_faults += 1
        if start:
            if not body:
                return
            stop = 1 + body[0]
            if pid in self.open:
                self.read(pid, self.open[pid] + body[1:stop])
                if self.open.pop(pid, b""):  # cut off by a new section
                    self.out.table_faults += 1
            self.read(pid, body[stop:])
        elif pid in self.open:
            self.read(pid, self.open[pid] + body)

    def read(self, pid: int, data: bytes) -> None:
        """Take whole sections; what is left waits for the next packet."""
        while len(data) >= 3 and data[0] != 0xFF:
            size = 3 + ((data[1] & 15) << 8 | data[2])
            if size > len(data):
                break
            self.section(pid, data[:size])
            data = data[size:]
        self.open.pop(pid, None)
        if data and data[0] != 0xFF:
            self.open[pid] = data

    def section(self, pid: int, sec: bytes) -> None:
        size = len(sec)
        if size < 12 or self.seen.get(pid) != sec and crc32_mpeg(sec):
            self.out.table_faults += 1
            return
        if self.seen.get(pid) == sec:
            return
        self.seen[pid] = sec
        if pid == PAT_PID:
            for i in range(8, size - 4, 4):
                number, of = int.from_bytes(sec[i : i + 2], "big"), int.from_bytes(sec[i + 2 : i + 4], "big") & NULL_PID
                if number:
                    self.out.programs[number] = of
                    self.seen.setdefault(of, b"")
            return
        i = 12 + ((sec[10] & 15) << 8 | sec[11])
        while i + 5 <= size - 4:
            of = int.from_bytes(sec[i + 1 : i + 3], "big") & NULL_PID
            self.out.streams.setdefault(of, Stream(of)).kind = sec[i]
            i += 5 + ((sec[i + 3] & 15) << 8 | sec[i + 4])


def demux(media: bytes) -> Parsed:
    """Parse a transport stream; never raises."""
    out, counters, last = Parsed(), {}, {}
    tables, at_packet = Tables(out), 0
    while at_packet + PACKET <= len(media):
        p = media[at_packet : at_packet + PACKET]
        if p[0] != SYNC:
            step = in_step(media, at_packet + 1)
            out.damaged += max(1, (step - at_packet) // PACKET)
            at_packet = step
            continue
        at_packet += PACKET
        out.packets += 1
        if p[1] & 0x80:
            out.damaged += 1
            continue
        pid, control = (p[1] & 31) << 8 | p[2], p[3] >> 4 & 3
        if pid == NULL_PID or not control & 1:
            continue
        rap, jump, clock, at = False, False, None, 4
        if control & 2:
            size = p[4]
            if size > PACKET - 5:
                out.damaged += 1
                continue
            if size:
                rap, jump = bool(p[5] & 0x40), bool(p[5] & 0x80)
            if size >= 7 and p[5] & 0x10:
                clock = (p[6] << 25 | p[7] << 17 | p[8] << 9 | p[9] << 1 | p[10] >> 7) * 300 + ((p[10] & 1) << 8 | p[11])
            at = 5 + size
        counter, broken = p[3] & 15, False
        was = counters.get(pid)
        if was is not None and not jump:
            if counter == was and last.get(pid) == p:
                continue  # a packet may be sent twice
            if counter != (was + 1 & 15):
                out.counter_faults += 1
                broken = True
        counters[pid], last[pid] = counter, p
        start, body = p[1] & 0x40, p[at:]
        if pid in tables.seen:
            tables.take(pid, bool(start), body, broken)
            continue
        s = out.streams.get(pid)
        if s is None:
            continue
        if start:
            out.damaged += s.close()
            s.rap, s.clock = rap, clock
            s.open_.append(body)
        elif s.open_:
            s.open_.append(body)
    out.table_faults += len(tables.open)
    for s in out.streams.values():
        out.damaged += s.close()
    return out


def padded(text: Column, to: int = 192) -> Column:
    """UTF-8 bytes of a text (null: none), filled with spaces up to a positive multiple."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    size = F.greatest(F.lit(to), F.ceil(F.octet_length(raw) / F.lit(to)) * to).cast("int")
    return F.rpad(raw, size, F.lit(b" "))


def to_media(payload: Column) -> Column:
    """A payload column as transport streams."""

    @F.arrow_udf("binary")
    def ts_mux(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if p is None else mux(p) for p in batch.to_pylist()], pa.binary())

    return ts_mux(payload)


PARSED = "struct<payload:binary,programs:int,kinds:string,units:array<struct<pts:bigint,random_access:boolean,size:int,dts:bigint,clock:bigint>>,packets:bigint,counter_faults:int,table_faults:int,damaged:int>"
_UNIT = pa.struct([("pts", pa.int64()), ("random_access", pa.bool_()), ("size", pa.int32()), ("dts", pa.int64()), ("clock", pa.int64())])
_ARROW = pa.struct([("payload", pa.binary()), ("programs", pa.int32()), ("kinds", pa.string()), ("units", pa.list_(_UNIT)), ("packets", pa.int64()), ("counter_faults", pa.int32()), ("table_faults", pa.int32()), ("damaged", pa.int32())])


def parse_media(media: Column) -> Column:
    """What the streams of a media column hold: see PARSED. Several elementary streams follow one another by packet id."""

    @F.arrow_udf(PARSED)
    def ts_demux(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for m in batch.to_pylist():
                p = demux(m or b"")
                streams = [p.streams[k] for k in sorted(p.streams)]
                units = [{"pts": t, "random_access": r, "size": n, "dts": d, "clock": c} for s in streams for t, r, n, d, c in s.units]
                rows.append({"payload": b"".join(x for s in streams for x in s.parts), "programs": len(p.programs), "kinds": ",".join(f"{s.pid}:{s.kind}" for s in streams), "units": units, "packets": p.packets, "counter_faults": p.counter_faults, "table_faults": p.table_faults, "damaged": p.damaged})
            yield pa.array(rows, _ARROW)

    return ts_demux(media)


def feature(parsed: Column) -> Column:
    """Streams, units, first and last time stamp, random-access points, packets and faults of a parsed column, as text."""
    units = parsed["units"]
    raps = F.size(F.filter(units, lambda u: u["random_access"]))
    stamps = F.transform(units, lambda u: u["pts"])
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    return F.concat(F.lit("streams="), parsed["kinds"], F.lit(";units="), F.size(units).cast("string"), F.lit(";pts="), text(F.array_min(stamps)), F.lit("-"), text(F.array_max(stamps)), F.lit(";random_access="), raps.cast("string"), F.lit(";packets="), parsed["packets"].cast("string"), F.lit(";faults="), (parsed["counter_faults"] + parsed["table_faults"] + parsed["damaged"]).cast("string"))
