"""Ogg containers in binary columns: write, verify, reassemble, demultiplex, time.

`write_ogg` multiplexes packets of logical streams into pages; `read_ogg` walks the pages of
any Ogg file: it verifies each page's checksum, joins packets from lacing values across pages and
separates logical streams by serial number. A page's granule position is that of the last packet that ends
in it; with the packets' durations the positions of the packets before it are worked back from there, and
divided by the rate they are times. Codecs of known durations are the stored payloads of this module and
Opus; packets of others have a time only where a page states it.

Edge cases: bytes that are null or no Ogg give no streams; a page with a wrong checksum or cut
short is counted as bad and left out, together with the packets that it breaks; sequence gaps
are counted; positions start anew from the next good page. A stored payload is put together by
positions, so a damaged one is reported as incomplete, never as another payload. An empty text is
stored as one block of spaces. Equal texts give equal files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from benefactor.llm.common import pick

#: Fixed values of the container: capture pattern, header layout, flag bits.
CAPTURE = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1

_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(data: bytes) -> int:
    """The container's CRC-32: polynomial 0x04c11db7, most significant bit first, zero start.

    zlib has the reflected form; flipping the bits of each byte and of the result turns it into
    this one, at C speed.
    """
    reflected = zlib.crc32(data.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_FLIP), "big")


def _lacing(size: int) -> list[int]:
    return [255] * (size // 255) + [size % 255]


def _page(flags: int, granule: int, serial: int, sequence: int, lacing: list[int], body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, sequence, 0, len(lacing)) + bytes(lacing)
    return head[:22] + struct.pack("<I", page_checksum(head + body)) + head[26:] + body


def write_ogg(streams: list[list[tuple[bytes, int]]], serials: list[int], most_segments: int = 255) -> bytes:
    """Streams of (packet, granule position after it), their pages taken in turn.

    Pages hold `most_segments` lacing values at most; a packet runs on where it does not fit. A stream's
    first packet has a page of its own.
    """
    waiting = []
    for packets, serial in zip(streams, serials, strict=True):
        segments: list[tuple[int, int, bool]] = []  # size, granule, whether a packet ends here
        for data, granule in packets:
            own = _lacing(len(data))
            segments += [(s, granule, i == len(own) - 1) for i, s in enumerate(own)]
        body, pages, at, inside = b"".join(p for p, _ in packets), [], 0, False
        head = len(_lacing(len(packets[0][0]))) if packets else 0
        cuts = [*range(0, head, most_segments), *range(head, len(segments), most_segments), len(segments)]
        for k, next_cut in zip(cuts[:-1], cuts[1:], strict=True):
            part = segments[k:next_cut]
            size = sum(s for s, _, _ in part)
            ended = [g for _, g, end in part if end]
            flags = CONTINUED * inside | FIRST * (k == 0) | LAST * (next_cut == len(segments))
            pages.append(_page(flags, ended[-1] if ended else NO_GRANULE, serial, len(pages), [s for s, _, _ in part], body[at : at + size]))
            at, inside = at + size, not part[-1][2]
        waiting.append(pages)
    out = []
    for turn in range(max((len(p) for p in waiting), default=0)):
        out += [pages[turn] for pages in waiting if turn < len(pages)]
    return b"".join(out)


@dataclass
class LogicalStream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)  # position after each packet; None where it is unknown
    pages: int = 0
    gaps: int = 0
    ended: bool = False
    _rest: list[bytes] | None = None
    _next: int = 0


@dataclass
class OggFile:
    streams: dict[int, LogicalStream] = field(default_factory=dict)
    bad_pages: int = 0


#: What `read_ogg` asks of a codec: the duration, in units of the granule position, of each packet, given the stream's first packet and the packet.
Duration = Callable[[bytes, bytes], int | None]


def read_ogg(data: bytes | None, duration: Duration | None = None) -> OggFile:
    """All streams of a file. duration: of packets; `codec_duration` if None."""
    duration = duration or codec_duration
    out, at = OggFile(), 0
    data = data or b""
    while (at := data.find(CAPTURE, at)) >= 0:
        if at + HEADER.size > len(data):
            out.bad_pages += 1
            break
        _, version, flags, granule, serial, sequence, checksum, count = HEADER.unpack_from(data, at)
        head_end = at + HEADER.size + count
        lacing = data[at + HEADER.size : head_end]
        end = head_end + sum(lacing)
        if version or len(lacing) < count or end > len(data) or page_checksum(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != checksum:
            out.bad_pages += 1
            at += 4
            continue
        stream = out.streams.setdefault(serial, LogicalStream(serial))
        if sequence != stream._next:
            stream.gaps += 1
            stream._rest = None
        stream._next = sequence + 1
        stream.pages += 1
        stream.ended |= bool(flags & LAST)
        rest = stream._rest if flags & CONTINUED else []
        place, ended = head_end, []  # the packets that end in this page; None for one whose start is lost
        for size in lacing:
            if rest is not None:
                rest.append(data[place : place + size])
            place += size
            if size < 255:
                ended.append(None if rest is None else b"".join(rest))
                rest = []
        stream._rest = rest if lacing and lacing[-1] == 255 else None
        _place(stream, ended, granule, duration)
        at = end
    return out


def _place(stream: LogicalStream, ended: list[bytes | None], granule: int, duration: Duration) -> None:
    """Add the packets that end in a page: the last is at the page's granule position, those before it by durations back."""
    first = stream.packets[0] if stream.packets else next((p for p in ended if p is not None), b"")
    position: int | None = granule if granule != NO_GRANULE else None
    placed = []
    for packet in reversed(ended):
        if packet is None:  # only the first can be lost
            break
        placed.append((packet, position))
        lasts = duration(first, packet)
        position = None if position is None or lasts is None else position - lasts
    for packet, where in reversed(placed):
        stream.packets.append(packet)
        stream.granules.append(where)


def codec_duration(first: bytes, packet: bytes) -> int | None:
    """Samples in a packet of a known codec; a head packet has none."""
    if first[:8] == _MAGIC:
        return 0 if packet is first or packet[:8] == _MAGIC else len(packet)
    if first[:8] == b"OpusHead":
        return 0 if packet[:8] in (b"OpusHead", b"OpusTags") else opus_samples(packet)
    return None


def codec_rate(first: bytes) -> int | None:
    """Granule positions in a second."""
    if first[:8] == _MAGIC and len(first) == _HEAD.size:
        return _HEAD.unpack(first)[1]
    return 48_000 if first[:8] == b"OpusHead" else None


#: Fixed values of Opus: samples at 48 kHz of a frame, by the upper five bits of a packet's first byte.
OPUS_FRAMES = [480, 960, 1920, 2880] * 3 + [480, 960] * 2 + [120, 240, 480, 960] * 4


def opus_samples(packet: bytes) -> int | None:
    """The packet's frames times their length, from its first bytes."""
    if not packet or packet[0] & 3 == 3 and len(packet) < 2:
        return None
    frames = (1, 2, 2, packet[1] & 63 if packet[0] & 3 == 3 else 0)[packet[0] & 3]
    return frames * OPUS_FRAMES[packet[0] >> 3]


#: The head packet of a stored payload: magic, sample rate, bits a sample, number of streams, this stream's place, samples in a block, samples in all.
_HEAD = struct.Struct("<8sIHHHIQ")
_MAGIC = b"PCMtext\0"


@dataclass(frozen=True)
class OggParams:
    rate: int = 8000  # samples a second, 8 bits each
    streams: int = 2  # blocks are dealt to them in turn
    block: int = 1920  # samples in a packet
    segments: int = 64  # lacing values in a page
    unit: int = 192  # the payload is padded to a positive multiple


def pad(data: bytes, unit: int) -> bytes:
    return data + b" " * (max(unit, -(-len(data) // unit) * unit) - len(data))


def store(payload: bytes, params: OggParams = OggParams()) -> bytes:
    """8-bit samples as packets of `block` samples, dealt to the logical streams in turn.

    Granule positions count the samples of the stream up to the packet's end.
    """
    streams = [[(_HEAD.pack(_MAGIC, params.rate, 8, params.streams, s, params.block, len(payload)), 0)] for s in range(params.streams)]
    ends = [0] * params.streams
    for k, at in enumerate(range(0, len(payload), params.block)):
        part, s = payload[at : at + params.block], k % params.streams
        ends[s] += len(part)
        streams[s].append((part, ends[s]))
    return write_ogg(streams, [0x5350 + s for s in range(params.streams)], params.segments)


def load(stored: bytes) -> tuple[bytes | None, str]:
    """The payload, put together from the streams by the positions of their packets, and a line of features.

    The payload is None if a part of it is missing; the features then speak of what is there.
    """
    ogg = read_ogg(stored)
    blocks: dict[int, bytes] = {}
    total = rate = 0
    last = 0.0
    for stream in ogg.streams.values():
        first = stream.packets[0] if stream.packets else b""
        if first[:8] != _MAGIC or len(first) != _HEAD.size:
            continue  # the head is lost, and with it the stream's place
        _, rate, _, streams, place, block, total = _HEAD.unpack(first)
        for packet, end in zip(stream.packets[1:], stream.granules[1:], strict=True):
            if end is not None:
                blocks[((end - len(packet)) // block * streams + place) * block] = packet
                last = max(last, end / rate)
    payload = b"".join(blocks[at] for at in sorted(blocks))
    samples = np.frombuffer(payload, np.uint8)
    signed = samples.astype(np.int16) - 128
    n = max(1, len(samples))
    crossings = int(np.count_nonzero((signed[1:] < 0) != (signed[:-1] < 0)))
    whole = total > 0 and len(payload) == total
    feature = (
        f"streams={len(ogg.streams)};pages={sum(s.pages for s in ogg.streams.values())};packets={sum(len(s.packets) for s in ogg.streams.values())};"
        f"bad={ogg.bad_pages};gaps={sum(s.gaps for s in ogg.streams.values())};ended={int(all(s.ended for s in ogg.streams.values()))};whole={int(whole)};"
        f"ms={last * 1000:.0f};sum={int(samples.sum(dtype=np.int64))};"
        f"rms={np.sqrt(np.square(signed, dtype=np.int32).sum(dtype=np.int64) / n):.4f};crossings={crossings}"
    )
    return payload if whole else None, feature


def packets(df: DataFrame, column: str, key: str) -> DataFrame:
    """All packets of a binary column: key, serial, packet number, granule (position after it), end_s (the same in seconds), n_bytes, data.

    granule and end_s are null where neither the page nor the codec tells.
    """

    def run(batches):
        for batch in batches:
            for k, blob in zip(batch.column(0), batch.column(1), strict=True):
                rows = [
                    (k.as_py(), s.serial, i, g, None if g is None or not (rate := codec_rate(s.packets[0])) else g / rate, len(p), p)
                    for s in read_ogg(blob.as_py()).streams.values()
                    for i, (p, g) in enumerate(zip(s.packets, s.granules, strict=True))
                ]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    names = ["key", "serial", "packet", "granule", "end_s", "n_bytes", "data"]
    kind = pick(df, key).schema[0].dataType
    arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(kind.simpleString(), pa.string())
    schema = pa.schema(list(zip(names, [arrow, pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.binary()], strict=True)))
    sql = f"key {kind.simpleString() if arrow != pa.string() else 'string'}, serial long, packet int, granule long, end_s double, n_bytes long, data binary"
    rows = pick(df, key, column)
    return rows.select(rows[key] if arrow != pa.string() else rows[key].cast("string"), rows[column]).mapInArrow(run, sql)


def media_digest(docs: DataFrame, params: OggParams = OggParams()) -> DataFrame:
    """Store each whole text as Ogg, read the stored bytes back, and report on both."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in names[1:]]
            for text in batch.column(1):
                buffer = text.as_buffer()
                raw = buffer.to_pybytes() if buffer is not None else b""
                stored = store(pad(raw, params.unit), params)
                payload, feature = load(stored)
                if payload is None:
                    raise ValueError("a payload that was just stored did not come back whole")
                row = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    return pick(docs, "doc_id", "text").mapInArrow(run, schema)
