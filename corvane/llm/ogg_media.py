"""Media columns: texts stored as 8-bit samples in Ogg files, and read back.

Writing: a file has two logical streams. The sound stream has a head packet (kind, sample rate, channels, block size), then packets of
samples; the note stream has one packet with the text's length in bytes. Pages hold up to 255 lacing values, carry a running number, the
stream's serial number, the granule position (samples up to the last packet that ends on the page) and a checksum.

Reading: every page's checksum is verified, packets are put together from lacing values, also over pages, the logical streams
are told apart by serial number, and each packet's time comes from the granule positions and the sample rate: the last packet that ends on a page
ends at the page's granule position, those before it end earlier by the samples of the packets after them. Positions that go back, or
that a page's packets don't fill up from the page before, are errors.

Defined results: a null text counts as empty; its payload is one block of spaces. Equal texts make equal files. A damaged file raises
OggError, or is reported as a damaged row by `read_column`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

BLOCK = 192
_HEAD = struct.Struct("<4sBBqIIIB")
_SOUND = struct.Struct("<8sIHH")
_NOTE = struct.Struct("<8sQ")
_NO_GRANULE = -1
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """A file that can't be read."""


@dataclass(frozen=True)
class OggConfig:
    """rate: samples a second of one channel. packet: samples in a packet, whole blocks."""

    rate: int = 8000
    packet: int = 10 * BLOCK


def page_checksum(page: bytes) -> int:
    """The CRC with polynomial 0x04C11DB7, first bit first, from 0: the common reflected CRC over mirrored bytes, mirrored."""
    raw = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")


@dataclass
class _Stream:
    """Pages of one logical stream in the making."""

    serial: int
    number: int = 0
    pages: list[bytes] = field(default_factory=list)

    def page(self, lacing: bytes, body: bytes, granule: int, carried: bool, first: bool, last: bool) -> None:
        kind = carried | first << 1 | last << 2
        head = _HEAD.pack(b"OggS", 0, kind, granule, self.serial, self.number, 0, len(lacing)) + lacing
        page = head + body
        self.pages.append(page[:22] + page_checksum(page).to_bytes(4, "little") + page[26:])
        self.number += 1

    def packets(self, packets: list[tuple[bytes, int]], first: bool, last: bool) -> None:
        """Appends packets with the granule position at each one's end; pages are cut at 255 lacing values."""
        lacing, granule_at, body = bytearray(), [], []
        for data, granule in packets:
            lacing += b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
            granule_at.append((len(lacing), granule))
            body.append(data)
        whole, place, at, carried = b"".join(body), 0, 0, False
        for begin in range(0, len(lacing), 255):
            part = bytes(lacing[begin : begin + 255])
            size, granule = sum(part), _NO_GRANULE
            while at < len(granule_at) and granule_at[at][0] <= begin + len(part):
                granule, at = granule_at[at][1], at + 1
            self.page(part, whole[place : place + size], granule, carried, first and not begin, last and begin + 255 >= len(lacing))
            place, carried = place + size, part[-1] == 255


def write(payload: bytes, n_bytes: int, config: OggConfig = OggConfig()) -> bytes:
    """An Ogg file with the payload as samples and the text's length as a note."""
    serial = zlib.crc32(payload)
    sound, note = _Stream(serial), _Stream(serial ^ 0xFFFFFFFF)
    sound.packets([(_SOUND.pack(b"PCM8mono", config.rate, 1, BLOCK), 0)], True, False)
    note.packets([(_NOTE.pack(b"textsize", n_bytes), 0)], True, True)
    size = config.packet
    sound.packets([(payload[i : i + size], min(i + size, len(payload))) for i in range(0, len(payload), size)], False, True)
    return b"".join([sound.pages[0], note.pages[0], *sound.pages[1:]])


@dataclass
class Packet:
    """A packet with the granule position of the page that it ends on, None where it isn't the last one to end there."""

    data: bytes
    granule: int | None


def demultiplex(data: bytes) -> dict[int, list[Packet]]:
    """The packets of each logical stream by serial number, all pages verified."""
    streams: dict[int, list[Packet]] = {}
    open_part: dict[int, list[bytes]] = {}
    numbers: dict[int, int] = {}
    ended: set[int] = set()
    at, view = 0, memoryview(data)
    while at < len(data):
        if len(data) < at + _HEAD.size:
            raise OggError("the file ends within a page's head")
        magic, version, kind, granule, serial, number, checksum, n = _HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        lacing = data[at + _HEAD.size : at + _HEAD.size + n]
        end = at + _HEAD.size + n + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise OggError("the file ends within a page")
        page = data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]
        if page_checksum(page) != checksum:
            raise OggError(f"wrong checksum of the page at byte {at}")
        if bool(kind & 2) == (serial in streams):
            raise OggError("a stream begins twice or not at all")
        if serial in ended or number != numbers.get(serial, -1) + 1:
            raise OggError("a page is missing, doubled or after the end of its stream")
        numbers[serial] = number
        packets, part = streams.setdefault(serial, []), open_part.setdefault(serial, [])
        if bool(kind & 1) != bool(part):
            raise OggError("a packet's continuation is missing")
        place, closed = at + _HEAD.size + n, []
        for value in lacing:
            part.append(bytes(view[place : place + value]))
            place += value
            if value < 255:
                closed.append(Packet(b"".join(part), None))
                part.clear()
        if closed and granule != _NO_GRANULE:
            closed[-1].granule = granule
        packets += closed
        if kind & 4:
            ended.add(serial)
        at = end
    if any(open_part.values()) or ended != set(streams):
        raise OggError("a stream doesn't end")
    return streams


@dataclass
class Sound:
    """What a file holds: samples as bytes, the text's length, and the time in microseconds at which each packet ends."""

    payload: bytes
    n_bytes: int
    rate: int
    times: list[int]


def read(data: bytes) -> Sound:
    """The sound and the note of a file; granule positions must agree with the samples."""
    sound = note = None
    for packets in demultiplex(data).values():
        head = packets[0].data if packets else b""
        if head[:8] == b"PCM8mono" and len(head) == _SOUND.size:
            sound = packets
        elif head[:8] == b"textsize" and len(head) == _NOTE.size:
            note = packets
    if sound is None or note is None:
        raise OggError("a stream is missing")
    rate = _SOUND.unpack(sound[0].data)[1]
    if not rate:
        raise OggError("the sample rate is zero")
    ends = granule_ends(sound[1:])
    return Sound(b"".join(p.data for p in sound[1:]), _NOTE.unpack(note[0].data)[1], rate, [end * 1_000_000 // rate for end in ends])


def granule_ends(packets: list[Packet]) -> list[int]:
    """The sample at which each packet ends, counted back from the granule position of its page."""
    ends, page, at = [], [], 0
    for packet in packets:
        page.append(packet)
        if packet.granule is None:
            continue
        end, own = packet.granule, []
        for each in reversed(page):
            own.append(end)
            end -= len(each.data)
        if end != at:
            raise OggError("a granule position doesn't agree with the samples")
        ends += own[::-1]
        at, page = packet.granule, []
    if page:
        raise OggError("a page with the end of a packet has no granule position")
    return ends


def payload_of(text: bytes) -> bytes:
    """The text with spaces up to a positive multiple of the block."""
    return text + b" " * (max(1, -(-len(text) // BLOCK)) * BLOCK - len(text))


def feature(sound: Sound) -> str:
    """Duration, packets, mean level and swing, energy of the loudest and the quietest block, crossings of the middle."""
    samples = np.frombuffer(sound.payload, np.uint8).astype(np.int64) - 128
    blocks = (samples**2).reshape(-1, BLOCK).sum(1)
    crossings = int(((samples[1:] < 0) != (samples[:-1] < 0)).sum())
    return f"us={sound.times[-1] if sound.times else 0};packets={len(sound.times)};sum={int(samples.sum())};energy={int(blocks.sum())};loudest={int(blocks.max())};quietest={int(blocks.min())};crossings={crossings}"


def store(docs: DataFrame, config: OggConfig = OggConfig(), keep: tuple[str, ...] = ("doc_id",), text: str = "text", media: bool = True) -> DataFrame:
    """The columns `keep` of each row with what was read back from its file; `media`: the file too, as a binary column."""
    ship(docs.sparkSession)
    frame = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("txt"))
    names = [f"k{i}" for i in range(len(keep))]
    more = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in batches:
            for begin in range(0, len(batch), 512):
                part = batch.slice(begin, 512)
                rows, files = [], []
                for value in part.column("txt"):
                    raw = value.as_py()
                    data = write(payload_of(raw), len(raw), config)
                    sound = read(data)
                    back = sound.payload
                    rows.append((sound.n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(sound)))
                    if media:
                        files.append(data)
                columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *columns, *([pa.array(files, pa.binary())] if media else [])], [*names, *more, *["media"] * media])

    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, frame.schema.fields, strict=False))
    schema = f"{fields}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * media
    return frame.mapInArrow(run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def read_column(media: DataFrame, keep: tuple[str, ...] = ("doc_id",), column: str = "media") -> DataFrame:
    """The columns `keep` of each row with payload, n_bytes, duration in microseconds and the error of a damaged or null file."""
    ship(media.sparkSession)
    frame = media.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(column).alias("file"))
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches):
        for batch in batches:
            for begin in range(0, len(batch), 512):
                part = batch.slice(begin, 512)
                rows = []
                for value in part.column("file"):
                    try:
                        sound = read(value.as_py() or b"")
                        rows.append((sound.payload, sound.n_bytes, sound.times[-1] if sound.times else 0, None))
                    except OggError as error:
                        rows.append((None, None, None, str(error)))
                columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), [pa.binary(), pa.int64(), pa.int64(), pa.string()], strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *columns], [*names, "payload", "n_bytes", "duration_us", "error"])

    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, frame.schema.fields, strict=False))
    return frame.mapInArrow(run, f"{fields}, payload binary, n_bytes long, duration_us long, error string").withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})
