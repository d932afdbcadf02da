"""Ogg media columns: multiplexing, checked reading and features.

Reader: finds pages by their capture pattern, checks each page's CRC-32 (polynomial 0x04C11DB7, most significant bit first),
reassembles packets from the lacing values across pages, demultiplexes logical streams by serial number and derives every
packet's time from the granule positions, counting back from the last packet that ends on a page.

Writer: a payload of bytes becomes unsigned 8-bit mono samples of an OggPCM stream; a second logical stream carries marks, one for
every few packets, with the sample position and the checksum of the samples before it.

Null media give no packets, null payloads are stored as empty; damaged pages are left out and counted, as are packets that lost a part; extra columns pass through;
equal payloads give equal bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cellweft.llm.common import map_rows

RATE = 8000
PACKET = 1920
MARK_EVERY = 16
UNIT = 192
AUDIO, MARKS = 1, 2
CONTINUED, FIRST, LAST = 1, 2, 4
HEADER = struct.Struct("<4sBBqIIIB")
PCM_HEADER = struct.Struct(">8sHHIIBBHI")
MARK_MAGIC = b"SAMPMARK"
MARK = struct.Struct("<QI")

#: zlib's CRC reads bits from the other end: reversing the bits of every byte and of the result gives Ogg's.
_FLIP = bytes(int(f"{n:08b}"[::-1], 2) for n in range(256))


def page_crc(page: bytes) -> int:
    """CRC of a page whose checksum field is zero."""
    raw = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_FLIP), "big")


@dataclass
class PageWriter:
    """Packs the packets of one logical stream into pages of up to 255 segments."""

    serial: int
    seq: int = 0
    lacing: bytearray = field(default_factory=bytearray)
    body: list[bytes] = field(default_factory=list)
    granule: int = -1
    continued: bool = False

    def page(self, flags: int = 0) -> bytes:
        flags |= (FIRST if self.seq == 0 else 0) | (CONTINUED if self.continued else 0)
        head = HEADER.pack(b"OggS", 0, flags, self.granule, self.serial, self.seq, 0, len(self.lacing)) + bytes(self.lacing)
        raw = head + b"".join(self.body)
        self.seq += 1
        self.lacing, self.body, self.granule = bytearray(), [], -1
        return raw[:22] + page_crc(raw).to_bytes(4, "little") + raw[26:]

    def add(self, packet: bytes, granule: int) -> Iterator[bytes]:
        """Pages that fill up while the packet is laid down."""
        lacing = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        at = 0
        while lacing:
            free = 255 - len(self.lacing)
            part, lacing = lacing[:free], lacing[free:]
            n = sum(part) if not lacing else 255 * len(part)
            self.lacing += part
            self.body.append(packet[at : at + n])
            at += n
            if not lacing:
                self.granule = granule
            if len(self.lacing) == 255:
                yield self.page()
                self.continued = bool(lacing)


def write(payload: bytes, rate: int = RATE) -> bytes:
    """The payload as an Ogg file of two logical streams."""
    audio, marks = PageWriter(AUDIO), PageWriter(MARKS)
    out = []
    out += audio.add(PCM_HEADER.pack(b"PCM     ", 0, 0, 1, rate, 8, 1, PACKET, 0), 0)
    out.append(audio.page())
    out += marks.add(MARK_MAGIC, 0)
    out.append(marks.page())
    crc, packets = 0, range(0, len(payload), PACKET)
    for k, at in enumerate(packets):
        part = payload[at : at + PACKET]
        end = at + len(part)
        out += audio.add(part, end)
        crc = zlib.crc32(part, crc)
        if (k + 1) % MARK_EVERY == 0 or end == len(payload):
            out += marks.add(MARK.pack(end, crc), end)
    out.append(audio.page(LAST))
    out.append(marks.page(LAST))
    return b"".join(out)


@dataclass
class Packet:
    serial: int
    number: int
    data: bytes
    #: position after the packet, in the stream's own units; None where no granule position follows on its page
    granule: int | None = None


@dataclass
class Media:
    packets: dict[int, list[Packet]] = field(default_factory=dict)
    pages: int = 0
    bad_pages: int = 0
    lost_packets: int = 0
    ended: set[int] = field(default_factory=set)


def read(data: bytes) -> Media:
    """Pages, checked; packets of every logical stream, reassembled."""
    media = Media()
    open_parts: dict[int, list[bytes] | None] = {}
    expected: dict[int, int] = {}
    at = 0
    while (at := data.find(b"OggS", at)) >= 0:
        if at + HEADER.size > len(data):
            media.bad_pages += 1
            break
        _, version, flags, granule, serial, seq, crc, n = HEADER.unpack_from(data, at)
        body = at + HEADER.size + n
        lacing = data[at + HEADER.size : body]
        end = body + sum(lacing)
        if version or len(lacing) < n or end > len(data) or page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            media.bad_pages += 1
            at += 4
            continue
        media.pages += 1
        packets = media.packets.setdefault(serial, [])
        parts = open_parts.pop(serial, None)
        if seq != expected.get(serial, seq) or bool(flags & CONTINUED) != (parts is not None):
            media.lost_packets += parts is not None
            parts = None
        expected[serial] = seq + 1
        skipping = bool(flags & CONTINUED) and parts is None
        done, pos, run = [], body, 0
        for k, size in enumerate(lacing):
            run += size
            if size < 255 or k == n - 1:
                piece = data[pos : pos + run]
                pos, run = pos + run, 0
                if size == 255:  # goes on in the next page of its stream
                    if not skipping:
                        open_parts[serial] = [*(parts or []), piece]
                elif skipping:
                    media.lost_packets += 1
                    skipping = False
                else:
                    done.append(Packet(serial, len(packets) + len(done), b"".join([*(parts or []), piece])))
                    parts = None
        if done and granule >= 0:
            after = 0
            for p in reversed(done):  # one unit a byte
                p.granule = granule - after
                after += len(p.data) if p.number else 0
        packets += done
        if flags & LAST:
            media.ended.add(serial)
        at = end
    media.lost_packets += len(open_parts)
    return media


def pcm_stream(media: Media) -> tuple[int, bytes, int]:
    """Rate, samples and the serial number of the first OggPCM stream."""
    for serial, packets in sorted(media.packets.items()):
        if packets and packets[0].data[:8] == b"PCM     ":
            return PCM_HEADER.unpack(packets[0].data)[4], b"".join(p.data for p in packets[1:]), serial
    raise ValueError("no PCM stream")


def check_marks(media: Media, samples: bytes) -> int:
    """Marks whose position and checksum agree with the samples; raises if one does not."""
    good, crc, at = 0, 0, 0
    for packets in media.packets.values():
        if packets and packets[0].data == MARK_MAGIC:
            for p in packets[1:]:
                end, want = MARK.unpack(p.data)
                crc, at = zlib.crc32(samples[at:end], crc), end
                if crc != want or p.granule is not None and p.granule > len(samples):
                    raise ValueError(f"the samples before {end} differ from their mark")
                good += 1
    return good


def features(media: Media) -> str:
    """Description of the sound: streams, pages, packets, marks, milliseconds, level, zero crossings, peak, last packet's time."""
    rate, samples, serial = pcm_stream(media)
    x = np.frombuffer(samples, np.uint8).astype(np.int32) - 128
    last = media.packets[serial][-1]
    parts = {
        "streams": len(media.packets),
        "pages": media.pages,
        "packets": len(media.packets[serial]) - 1,
        "marks": check_marks(media, samples),
        "ms": len(samples) * 1000 // rate,
        "last_ms": ((last.granule or 0) - len(last.data)) * 1000 // rate,
        "mean": int(x.sum()) * 1000 // max(len(x), 1),
        "power": int((x * x).sum(dtype=np.int64)) // max(len(x), 1),
        "crossings": int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))),
        "peak": int(np.abs(x).max(initial=0)),
    }
    return ";".join(f"{k}={v}" for k, v in parts.items())


def pad(payload: bytes, unit: int = UNIT) -> bytes:
    """Spaces up to a positive multiple of the unit."""
    return payload + b" " * (unit - len(payload) if not payload else -len(payload) % unit)


STORED_SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_texts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Store each text as media, read the stored bytes back and describe what was read. Row by row: a task holds one text's media."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for value in batch[text]:
                raw = value.encode("utf-8", "surrogatepass") if isinstance(value, str) else b""
                stored = write(pad(raw))
                media = read(stored)
                if media.bad_pages or media.lost_packets:
                    raise ValueError("the stored media are damaged")
                got = pcm_stream(media)[1]
                rows.append((len(raw), len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), features(media)))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in STORED_SCHEMA.split(", ")])
            out.insert(0, key, batch[key].to_numpy())
            yield out

    return map_rows(df, key, [text], run, STORED_SCHEMA)


def read_packets(df: DataFrame, key: str, media: str, rate: int = RATE) -> DataFrame:
    """Rows (key, serial, packet, start_ms, n_bytes, data, bad_pages, lost_packets) of a binary column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, value in zip(batch[key], batch[media], strict=True):
                if value is None:
                    continue
                m = read(bytes(value))
                rows = [
                    (k, serial, p.number, None if p.granule is None else (p.granule - (len(p.data) if p.number else 0)) * 1000 // rate, len(p.data), p.data, m.bad_pages, m.lost_packets)
                    for serial, packets in sorted(m.packets.items())
                    for p in packets
                ]
                yield pd.DataFrame(rows, columns=[key, "serial", "packet", "start_ms", "n_bytes", "data", "bad_pages", "lost_packets"]).astype({"start_ms": "Int64"})

    return map_rows(df, key, [media], run, "serial long, packet long, start_ms long, n_bytes long, data binary, bad_pages long, lost_packets long")
