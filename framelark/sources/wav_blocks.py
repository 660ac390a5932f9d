"""WAV files as blocks of samples: a data source that splits a file among tasks.

    spark.dataSource.register(WavBlocks)
    spark.read.format("wav_blocks").option("halo", 2303).load(folder)

gives (track, block, halo, samples), track being the path below the folder: block b holds the samples from b * span on, at the
target rate, of the file's first channel, and `halo` those before it. A file is cut into ranges of `split`
bytes; a range gives the blocks whose first sample lies in it, and its task reads just the bytes that they, their
halo and the resampling filter need. So a file of any length feeds many tasks, and no block depends on how files were split.
Files are opened by Arrow's file systems (file, hdfs, s3, gs); the driver lists them and reads no content.

Options: target (sample rate; default: the file's), span (samples of a block), halo, split (bytes).
A broken file fails the read with its name. An empty data section gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from framelark.operators.blocks import SPAN, Resampler

SPLIT = 64 << 20
SCHEMA = "track string, block long, halo array<float>, samples array<float>"
#: codes of sample formats in a WAV file's header
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


@dataclass(frozen=True)
class Layout:
    """Where a file's samples are, and how."""

    rate: int
    channels: int
    bits: int
    kind: int
    begin: int
    frames: int

    @property
    def width(self) -> int:
        return self.channels * self.bits // 8

    def decode(self, data: bytes) -> np.ndarray:
        """First channel in -1..1."""
        n = len(data) // self.width
        raw = np.frombuffer(data, np.uint8, n * self.width).reshape(n, self.width)[:, : self.bits // 8]
        if self.kind == FLOAT:
            return np.ascontiguousarray(raw).view("<f4" if self.bits == 32 else "<f8").ravel().astype(np.float32)
        if self.bits == 8:
            return ((raw.ravel().astype(np.float32)) - 128) / np.float32(128)
        wide = np.zeros((n, 4), np.uint8)
        wide[:, 4 - self.bits // 8 :] = raw  # left-aligned, so that every width has its sign in the same place
        return (wide.view("<i4").ravel() / 2147483648.0).astype(np.float32)


def layout(file, size: int, name: str) -> Layout:
    """From the chunks of a RIFF file; only their heads are read."""
    head = file.read_at(12, 0) if size >= 12 else b""
    if head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise ValueError(f"{name}: not a RIFF/WAVE file")
    at, form = 12, None
    while at + 8 <= size:
        kind, length = struct.unpack("<4sI", file.read_at(8, at))
        if kind == b"fmt ":
            body = file.read_at(min(length, 40), at + 8)
            if len(body) < 16:
                raise ValueError(f"{name}: the format chunk is cut short")
            form = list(struct.unpack_from("<HHIIHH", body))
            if form[0] == EXTENSIBLE and len(body) >= 26:
                form[0] = struct.unpack_from("<H", body, 24)[0]
        elif kind == b"data":
            if form is None:
                raise ValueError(f"{name}: data before its format")
            code, channels, rate, _, _, bits = form
            if (code, bits) not in {(PCM, 8), (PCM, 16), (PCM, 24), (PCM, 32), (FLOAT, 32), (FLOAT, 64)} or not channels or not rate:
                raise ValueError(f"{name}: unsupported samples: format {code}, {bits} bits, {channels} channels, {rate} Hz")
            length = min(length, size - at - 8)  # a file that was cut, or whose length was never written
            return Layout(rate, channels, bits, code, at + 8, length // (channels * bits // 8))
        at += 8 + length + length % 2
    raise ValueError(f"{name}: no data chunk")


@dataclass
class Range(InputPartition):
    path: str
    track: str
    begin: int
    end: int


class WavBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WavReader(self.options)


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.target = int(options["target"]) if options.get("target") else None
        self.span, self.halo, self.split = int(options.get("span", SPAN)), int(options.get("halo", 0)), int(options.get("split", SPLIT))
        if self.span < 1 or self.halo < 0 or self.split < 1:
            raise ValueError("span and split are positive, halo is not negative")

    def partitions(self) -> list[InputPartition]:
        system, path = fs.FileSystem.from_uri(self.path if ":" in self.path else f"file://{self.path}")
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.extension.lower() == "wav")
        return [Range(p, p.removeprefix(path).strip("/") or p.rsplit("/", 1)[-1], a, min(a + self.split, size)) for p, size in files for a in range(0, max(size, 1), self.split)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path if ":" in self.path else f"file://{self.path}")
        with system.open_input_file(part.path) as file:
            form = layout(file, file.size(), part.track)
            r = Resampler(form.rate, self.target) if self.target and self.target != form.rate else None
            total = r.outputs(form.frames) if r else form.frames
            place = lambda m: form.begin + (m * r.down // r.up if r else m) * form.width  # noqa: E731  byte of an output's input
            block = self._first(part.begin, place, total)
            while block * self.span < total and place(block * self.span) < part.end:
                first, last = block * self.span, min((block + 1) * self.span, total)
                x = self._samples(file, form, r, max(first - self.halo, 0), last)
                k = first - max(first - self.halo, 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.track]), pa.array([block]), pa.array([x[:k]], pa.list_(pa.float32())), pa.array([x[k:]], pa.list_(pa.float32()))],
                    names=["track", "block", "halo", "samples"],
                )
                block += 1

    def _first(self, begin: int, place, total: int) -> int:
        """The first block whose first sample does not lie before `begin`."""
        lo, hi = 0, -(-total // self.span)
        while lo < hi:
            middle = (lo + hi) // 2
            lo, hi = (middle + 1, hi) if place(middle * self.span) < begin else (lo, middle)
        return lo

    def _samples(self, file, form: Layout, r: Resampler | None, first: int, last: int) -> np.ndarray:
        """Samples first..last - 1 at the target rate; not finite ones are 0."""
        lo, hi = r.inputs(first, last) if r else (first, last)
        lo, hi = max(lo, 0), min(hi, form.frames)
        x = np.nan_to_num(form.decode(file.read_at((hi - lo) * form.width, form.begin + lo * form.width)), nan=0.0, posinf=0.0, neginf=0.0)
        return r.run(x, lo, first, last) if r else x


def read_wav_blocks(spark, path: str, **options):
    spark.dataSource.register(WavBlocks)
    reader = spark.read.format("wav_blocks")
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load(path)
