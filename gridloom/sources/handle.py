"""Inputs: paths that Spark reads, and streams that are replayed without being closed or moved."""

from __future__ import annotations

import io
import os
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import FileError

FILES = "path string, modificationTime timestamp, length bigint, content binary"


class SourceHandle:
    """A path or a binary stream. Streams are never closed; one that can't seek is read once, at the first need."""

    def __init__(self, source: Any, filename: str | None = None):
        if isinstance(source, SourceHandle):
            source, filename = source._source, filename or source._filename
        self._source, self._filename, self._bytes = source, filename, None
        self.is_path = isinstance(source, (str, os.PathLike))
        self.closed = False
        if not self.is_path and not isinstance(source, (bytes, bytearray, memoryview)) and not hasattr(source, "read"):
            raise TypeError(f"not a path, bytes or a binary stream: {type(source).__name__}")
        if not self.is_path and hasattr(source, "read") and not self._seekable():
            self.read_bytes()

    def _seekable(self) -> bool:
        probe = getattr(self._source, "seekable", None)
        return bool(probe and probe())

    @property
    def path(self) -> str | None:
        return os.fspath(self._source) if self.is_path else None

    @property
    def filename_hint(self) -> str | None:
        name = self._filename or self.path or getattr(self._source, "name", None)
        return name if isinstance(name, str) else None

    @property
    def description(self) -> str:
        return self.path or self.filename_hint or f"<{type(self._source).__name__}>"

    @property
    def identity(self) -> tuple[str, float] | None:
        """A path and its time of change, for caches; streams have none."""
        if self.is_path and os.path.exists(self.path):
            return self.path, os.path.getmtime(self.path)
        return None

    def read_bytes(self) -> bytes:
        """All bytes; a stream's place is restored, even if reading fails."""
        if self.closed:
            raise ValueError("the source is closed")
        if self._bytes is None:
            if self.is_path:
                try:
                    with open(self.path, "rb") as f:
                        self._bytes = f.read()
                except FileNotFoundError as e:
                    raise FileError("File not found", file_path=self.path) from e
            elif hasattr(self._source, "read"):
                self._bytes = self._read_stream()
            else:
                self._bytes = bytes(self._source)
        return self._bytes

    def _read_stream(self) -> bytes:
        if not self._seekable():
            return bytes(self._source.read())
        at = self._source.tell()
        try:
            self._source.seek(0)
            return bytes(self._source.read())
        finally:
            self._source.seek(at)

    def detached_binary(self) -> io.BytesIO:
        return io.BytesIO(self.read_bytes())

    @contextmanager
    def open_binary(self) -> Iterator[io.BytesIO]:
        with io.BytesIO(self.read_bytes()) as f:
            yield f

    def files(self, spark: SparkSession) -> DataFrame:
        """The input in the shape of Spark's binaryFile source."""
        if self.is_path:
            return spark.read.format("binaryFile").load(self.path)
        data = self.read_bytes()
        row = (self.description, None, len(data), bytearray(data))
        return spark.createDataFrame([row], FILES)

    def close(self) -> None:
        """Forgets the bytes; the caller's stream stays open."""
        self._bytes, self.closed = None, True
