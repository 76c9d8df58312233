"""Sinks whose writes may be repeated: a retried task leaves the same files behind."""

from __future__ import annotations

import asyncio
import hashlib
import json
import urllib.parse
from collections.abc import Awaitable, Callable
from typing import Any

import pyarrow as pa

from rillworks.operators.author import AsyncSink, OperatorContext

Writer = Callable[[str, dict[str, Any]], Awaitable[None]]


def _file_system(uri: str):
    from pyarrow import fs as pafs

    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class ParquetSink(AsyncSink):
    """One Parquet file per batch, named by a digest of its rows."""

    def __init__(self, uri: str):
        self.uri = uri

    async def write(self, batch: pa.RecordBatch) -> None:
        if batch.num_rows:
            await asyncio.to_thread(self._write, batch)

    def _write(self, batch: pa.RecordBatch) -> None:
        import pyarrow.parquet as pq

        fs, base = _file_system(self.uri)
        fs.create_dir(base)
        raw = pa.BufferOutputStream()
        with pa.ipc.new_stream(raw, batch.schema) as stream:
            stream.write_batch(batch)
        name = hashlib.blake2b(raw.getvalue(), digest_size=16).hexdigest()
        pq.write_table(pa.Table.from_batches([batch]), f"{base}/{name}.parquet", filesystem=fs)


class UpsertSink(AsyncSink):
    """One JSON object per key: a later write of a key replaces the earlier one, and a repeated write changes nothing.

    Rows of a key go to one task.  A writer of one's own takes (key, row) instead of files.
    """

    def __init__(self, uri: str, key: str = "item_id", writer: Writer | None = None):
        self.uri, self.key, self.writer = uri, key, writer

    def open(self, ctx: OperatorContext) -> None:
        if self.writer is None:
            fs, base = _file_system(self.uri)
            fs.create_dir(base, recursive=True)

            def put(key: str, row: dict[str, Any]) -> None:
                with fs.open_output_stream(f"{base}/{urllib.parse.quote(key, safe='')}.json") as file:
                    file.write(json.dumps(row, default=str).encode())

            self.writer = lambda key, row: asyncio.to_thread(put, key, row)

    def key_columns(self) -> tuple[str, ...]:
        return (self.key,)

    def max_in_flight(self) -> int:
        return 1  # batches of a task in their order, so the last row of a key stays

    async def write(self, batch: pa.RecordBatch) -> None:
        for row in batch.to_pylist():
            await self.writer(str(row[self.key]), row)
