"""Recordings in the NSx binary format, as a Python data source.

``spark.read.format("nsx").load(path)`` gives rows (path, packet, chunk, t0,
chan, label, samples): arrays of consecutive samples of one channel, never a row
for each sample.  Partitions are ranges of chunks crossed with groups of
channels; each seeks to its bytes.  Filters on ``chunk`` and ``chan`` are pushed
down to the choice of partitions.

Options: ``start`` and ``stop`` (one-based sample range, both included), or
``ranges`` ("a-b,c-d", which adds a row group number ``range_id``);
``chunk_samples``; ``channels`` in a partition.

Where a file holds several packets only what stands before a pause is read,
but a first packet of one sample is a false start and the last packet is read
instead.  A truncated file is read to its last whole frame.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

# Fixed values of the format: samples a second by extension; lengths in bytes.
RATES = {"ns1": 500, "ns2": 1000, "ns3": 2000, "ns4": 10000, "ns5": 30000, "ns6": 30000}
_BASIC, _CHANNEL, _PACKET = 314, 66, 9
SCHEMA = "path string, range_id int, chunk bigint, t0 bigint, chan int, label string, samples array<float>"


@dataclass(frozen=True)
class Header:
    version: str
    period: int
    channel_count: int
    nip_start: int  # of the recording, by the header; clock offsets count from it
    packet_start: int  # of the packet whose samples are read
    channels: tuple[tuple[int, str, int, int, int, int], ...]  # id, label, digital and analog bounds
    data_start: int
    n_samples: int
    pauses: bool

    @property
    def scale(self) -> float:
        """From counts to values, by the bounds of the first channel."""
        if not self.channels:
            return 1.0
        _, _, low_dig, high_dig, low, high = self.channels[0]
        return (high - low) / (high_dig - low_dig)


def read_header(path: str) -> Header:
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        kind = f.read(8)
        if kind == b"NEURALSG":
            f.read(16)
            period, count = struct.unpack("<II", f.read(8))
            ids = struct.unpack(f"<{count}I", f.read(4 * count))
            channels = tuple((i, str(i), -32768, 32767, -32768, 32767) for i in ids)
            start = f.tell()
            return Header("2.1", period, count, 0, 0, channels, start, (size - start) // (2 * count), False)
        major, minor, length = struct.unpack("<BBI", f.read(6))
        f.read(16 + 252)
        begun, period, _, *_, count = struct.unpack("<III8HI", f.read(32))
        channels = []
        for _ in range(count):
            raw = f.read(_CHANNEL)
            chan = struct.unpack_from("<H", raw, 2)[0]
            label = raw[4:20].split(b"\0")[0].decode("latin-1")
            bounds = struct.unpack_from("<4h", raw, 22)
            channels.append((chan, label, *bounds))
        f.seek(length)
        packets = []
        while f.tell() + _PACKET <= size:
            mark, t0, n = struct.unpack("<BII", f.read(_PACKET))
            if mark != 1:
                raise ValueError(f"{path}: no packet mark at byte {f.tell() - _PACKET}")
            # A length of zero, like one beyond the file, means up to its end.
            room = (size - f.tell()) // (2 * count) if count else 0
            packets.append((t0, min(n, room) if n else room, f.tell()))
            if not n or n > room:
                break
            f.seek(f.tell() + 2 * count * n)
        if not packets:
            packets = [(0, 0, size)]
        chosen = packets[-1] if len(packets) > 1 and packets[0][1] == 1 else packets[0]
        return Header(f"{major}.{minor}", period, count, begun, chosen[0], tuple(channels), chosen[2], chosen[1], len(packets) > 1)


def write(path: str, samples: np.ndarray, period: int = 1, nip_start: int = 0, labels: list[str] | None = None, bounds: tuple[int, int, int, int] = (-32768, 32767, -8192, 8191), packet_start: int | None = None) -> None:
    """A file with one packet of int16 ``samples`` [sample, channel]."""
    n, count = samples.shape
    labels = labels or [f"chan{i + 1}" for i in range(count)]
    with open(path, "wb") as f:
        f.write(b"NEURALCD" + struct.pack("<BBI", 2, 2, _BASIC + _CHANNEL * count) + b"\0" * 268)
        f.write(struct.pack("<III8HI", nip_start, period, 30000, *[0] * 8, count))
        for i, label in enumerate(labels):
            f.write((b"CC" + struct.pack("<H", i + 1) + label.encode("latin-1")[:16].ljust(16, b"\0") + b"\0\0" + struct.pack("<4h", *bounds)).ljust(_CHANNEL, b"\0"))
        f.write(struct.pack("<BII", 1, nip_start if packet_start is None else packet_start, n) + np.ascontiguousarray(samples, "<i2").tobytes())


def write_range(source: str, target: str, start: int, stop: int) -> None:
    """Samples ``start`` to ``stop`` (one-based, included) under the same header."""
    head = read_header(source)
    stop = min(stop, head.n_samples)
    with open(source, "rb") as f, open(target, "wb") as g:
        prefix = f.read(head.data_start)
        if head.version != "2.1":
            prefix = prefix[:-_PACKET] if not head.pauses else prefix[: _BASIC + _CHANNEL * head.channel_count]
            prefix += struct.pack("<BII", 1, head.packet_start + (start - 1) * head.period, stop - start + 1)
        g.write(prefix)
        f.seek(head.data_start + (start - 1) * 2 * head.channel_count)
        g.write(f.read((stop - start + 1) * 2 * head.channel_count))


@dataclass
class _Part(InputPartition):
    path: str
    range_id: int
    first: int
    last: int
    chunk_samples: int
    chans: tuple[int, ...]


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.bounds: dict[str, list[float]] = {"chunk": [0, float("inf")], "chan": [0, float("inf")]}
        self.chosen: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else ""
            if isinstance(f, In) and name == "chan":
                self.chosen = {v for v in f.value if v is not None}
            elif name in self.bounds and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                low = self.bounds[name]
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    low[0] = max(low[0], f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    low[1] = min(low[1], f.value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        path = self.options["path"].removeprefix("file://")
        files = sorted(glob.glob(os.path.join(path, "*.ns[1-6]"))) if os.path.isdir(path) else [path]
        size = int(self.options.get("chunk_samples", 3000))
        width = int(self.options.get("channels", 32))
        out: list[InputPartition] = []
        for file in files:
            head = read_header(file)
            if "ranges" in self.options:
                ranges = [tuple(map(int, r.split("-"))) for r in self.options["ranges"].split(",")]
            else:
                ranges = [(int(self.options.get("start", 1)), int(self.options.get("stop", head.n_samples)))]
            chans = [c for c in range(head.channel_count) if self.bounds["chan"][0] <= c <= self.bounds["chan"][1] and (self.chosen is None or c in self.chosen)]
            for number, (a, b) in enumerate(ranges):
                a, b = max(a, 1), min(b, head.n_samples)
                chunks = range(int(max((a - 1) // size, self.bounds["chunk"][0])), int(min((b - 1) // size, self.bounds["chunk"][1])) + 1)
                for k in range(0, len(chunks), 8):
                    own = chunks[k : k + 8]
                    first, last = max(a, own[0] * size + 1), min(b, (own[-1] + 1) * size)
                    for c in range(0, len(chans), width):
                        out.append(_Part(file, number, first, last, size, tuple(chans[c : c + width])))
        return out

    def read(self, partition: _Part) -> Iterator[tuple]:
        head = read_header(partition.path)
        count, size = head.channel_count, partition.chunk_samples
        with open(partition.path, "rb") as f:
            at = partition.first
            while at <= partition.last:
                chunk = (at - 1) // size
                stop = min(partition.last, (chunk + 1) * size)
                f.seek(head.data_start + (at - 1) * 2 * count)
                block = np.frombuffer(f.read((stop - at + 1) * 2 * count), "<i2").reshape(-1, count)
                for c in partition.chans:
                    label = head.channels[c][1] if head.channels else ""
                    values = (block[:, c].astype(np.float32) * np.float32(head.scale)).tolist()
                    yield partition.path, partition.range_id, chunk, head.packet_start + (at - 1) * head.period, c, label, values
                at = stop + 1


class NsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "nsx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))
