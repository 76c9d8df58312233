"""Chunked arrays in the Zarr v2 layout, read selection by selection inside tasks.

An array is a folder with a `.zarray` description and a file per chunk.  Folders are read through
Arrow file systems (local, or any URI they know).  Chunks may be plain, zlib, gzip or zstd; a chunk
that isn't there holds the fill value.
"""

from __future__ import annotations

import asyncio
import gzip
import itertools
import json
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillworks.operators.arrow import map_async
from rillworks.sources.connector import chunks

#: One item per axis: a position (which drops the axis) or a slice with step 1.
Selection = tuple[int | slice, ...]


def _zstd(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(raw)


_UNPACK: dict[str, Callable[[bytes], bytes]] = {"zlib": zlib.decompress, "gzip": gzip.decompress, "zstd": _zstd}


class ZarrArray:
    """One array; `read` fetches only the chunks that a selection touches."""

    def __init__(self, uri: str):
        self.fs, self.base = pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
        about = json.loads(self._file(".zarray"))
        if about["zarr_format"] != 2 or about["order"] != "C" or about.get("filters"):
            raise ValueError(f"{uri}: only Zarr v2 arrays in C order without filters are read")
        packing = (about.get("compressor") or {}).get("id")
        if packing is not None and packing not in _UNPACK:
            raise ValueError(f"{uri}: no reader for {packing} chunks; there are {', '.join(_UNPACK)}")
        self.unpack = _UNPACK.get(packing, bytes)
        self.shape, self.chunks = tuple(about["shape"]), tuple(about["chunks"])
        self.dtype, self.separator = np.dtype(about["dtype"]), about.get("dimension_separator", ".")
        self.fill = 0 if about["fill_value"] is None else about["fill_value"]

    def _file(self, name: str) -> bytes:
        with self.fs.open_input_stream(f"{self.base}/{name}") as file:
            return file.read()

    def _chunk(self, at: tuple[int, ...]) -> np.ndarray:
        try:
            raw = self._file(self.separator.join(map(str, at)) or "0")
        except FileNotFoundError:
            return np.full(self.chunks, self.fill, dtype=self.dtype)
        return np.frombuffer(self.unpack(raw), dtype=self.dtype).reshape(self.chunks)

    def read(self, selection: Selection = ()) -> np.ndarray:
        if len(selection) > len(self.shape):
            raise IndexError(f"{len(selection)} positions for {len(self.shape)} axes")
        wanted = [*selection, *[slice(None)] * (len(self.shape) - len(selection))]
        bounds = []
        for item, size in zip(wanted, self.shape):
            if isinstance(item, slice):
                start, stop, step = item.indices(size)
                if step != 1:
                    raise ValueError("slices have step 1")
                bounds.append((start, max(start, stop)))
            elif -size <= item < size:
                bounds.append((item % size, item % size + 1))
            else:
                raise IndexError(f"position {item} of an axis of {size}")
        out = np.empty([b - a for a, b in bounds], dtype=self.dtype)
        spans = [range(a // c, -(-b // c)) if b > a else range(0) for (a, b), c in zip(bounds, self.chunks)]
        for at in itertools.product(*spans):
            inner, outer = [], []
            for i, (a, b), c in zip(at, bounds, self.chunks):
                low, high = max(a, i * c), min(b, (i + 1) * c)
                inner.append(slice(low - i * c, high - i * c))
                outer.append(slice(low - a, high - a))
            out[tuple(outer)] = self._chunk(at)[tuple(inner)]
        return out[tuple(0 if not isinstance(item, slice) else slice(None) for item in wanted)]


def _table(columns: dict[str, np.ndarray]) -> pa.Table:
    return pa.table({name: pa.array(np.ascontiguousarray(values)) for name, values in columns.items()})


def _opened() -> Callable[[str], ZarrArray]:
    """Arrays opened once per task."""
    known: dict[str, ZarrArray] = {}
    return lambda uri: known[uri] if uri in known else known.setdefault(uri, ZarrArray(uri))


def slices(
    spark: SparkSession,
    uri: str,
    variables: Sequence[str],
    selections: Sequence[Selection],
    slice_columns: Callable[[Selection, dict[str, np.ndarray]], dict[str, np.ndarray]],
    schema: T.StructType | str,
    prefetch: int = 8,
) -> DataFrame:
    """Rows of the selections of a group's arrays: `slice_columns(selection, {variable: array})` gives the columns.

    Selections are spread over tasks; a task keeps `prefetch` reads going while rows move on.
    """
    names, opened = list(variables), _opened()

    async def read(selection: Selection) -> pa.Table:
        arrays = await asyncio.gather(*(asyncio.to_thread(lambda v=v: opened(f"{uri}/{v}").read(selection)) for v in names))
        return _table(slice_columns(selection, dict(zip(names, arrays))))

    return chunks(spark, list(selections), read, schema, prefetch)


def forecasts(
    spark: SparkSession,
    models: Sequence[tuple[int, str, Sequence[int]]],
    n_leads: int,
    cell_ids: np.ndarray,
    valid_gid: Callable[[int, int, np.ndarray], np.ndarray | None],
    variable: str = "2m_temperature",
    prefetch: int = 8,
) -> DataFrame:
    """(mlkey, gid, temp_f) of several models' stores, one (start, lead) slice at a time.

    `models` holds (model, uri, positions of its starts in that store); mlkey is model * n_leads +
    lead, and `valid_gid(start, lead, cell_ids)` names the cells a slice is true for, or None where
    nothing is known of them.
    """
    opened = _opened()
    wanted = [(model, uri, start, at, lead) for model, uri, starts in models for start, at in enumerate(starts) for lead in range(n_leads)]
    nothing = {"mlkey": np.zeros(0, np.int64), "gid": np.zeros(0, np.int64), "temp_f": np.zeros(0, np.float32)}

    async def read(selection: tuple[int, str, int, int, int]) -> pa.Table:
        model, uri, start, at, lead = selection
        gid = valid_gid(start, lead, cell_ids)
        if gid is None:
            return _table(nothing)
        field = await asyncio.to_thread(lambda: opened(f"{uri}/{variable}").read((at, lead)))
        return _table({"mlkey": np.full(gid.size, model * n_leads + lead, np.int64), "gid": gid.astype(np.int64), "temp_f": field.reshape(-1).astype(np.float32)})

    return chunks(spark, wanted, read, "mlkey long, gid long, temp_f float", prefetch)


def read_chunks(
    df: DataFrame, uri: str, variable: str, slice_columns: Callable[[int, np.ndarray], dict[str, np.ndarray]], schema: T.StructType | str, max_in_flight: int = 8
) -> DataFrame:
    """Rows of the slices along the first axis that a frame's `chunk_idx` names; reads overlap and end in any order."""
    opened = _opened()

    async def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        wanted = batch.column(0).to_pylist()
        data = await asyncio.gather(*(asyncio.to_thread(lambda i=i: opened(f"{uri}/{variable}").read((i,))) for i in wanted))
        tables = [_table(slice_columns(i, array)) for i, array in zip(wanted, data)]
        return pa.concat_tables(tables).combine_chunks().to_batches(max_chunksize=None)[0] if tables else empty

    declared = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    from rillworks.operators.arrow import empty_batch

    empty = empty_batch(declared)
    return map_async(df.select(F.col("chunk_idx").cast("long")), read, declared, max_in_flight, ordered=False)


def write(uri: str, data: np.ndarray, chunk_shape: Sequence[int], packing: str | None = "zlib", fill: float | None = 0) -> None:
    """Write an array in this layout, for tests and small exports."""
    import zstandard

    pack = {None: bytes, "zlib": zlib.compress, "gzip": gzip.compress, "zstd": zstandard.ZstdCompressor().compress}[packing]
    fs, base = pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    fs.create_dir(base)
    about = {"zarr_format": 2, "shape": data.shape, "chunks": list(chunk_shape), "dtype": data.dtype.str, "compressor": {"id": packing} if packing else None, "fill_value": fill, "order": "C", "filters": None}
    with fs.open_output_stream(f"{base}/.zarray") as file:
        file.write(json.dumps(about).encode())
    for at in itertools.product(*(range(-(-n // c)) for n, c in zip(data.shape, chunk_shape))):
        chunk = np.full(chunk_shape, 0 if fill is None else fill, dtype=data.dtype)
        part = data[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunk_shape))]
        chunk[tuple(slice(0, n) for n in part.shape)] = part
        with fs.open_output_stream(f"{base}/{'.'.join(map(str, at))}") as file:
            file.write(pack(chunk.tobytes()))
