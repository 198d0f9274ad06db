"""A small cache of evidence: path, sheet, time of change and variant."""

from __future__ import annotations

from collections import OrderedDict
from threading import RLock
from typing import Any


class StructureCache:
    """Least recently used entries go first. Keys start with the path."""

    def __init__(self, size: int = 128):
        if size < 1:
            raise ValueError("size must be 1 or more")
        self.size, self._lock = size, RLock()
        self._kept: OrderedDict[tuple, Any] = OrderedDict()

    def get(self, key: tuple) -> Any:
        with self._lock:
            if key in self._kept:
                self._kept.move_to_end(key)
            return self._kept.get(key)

    def put(self, key: tuple, value: Any) -> None:
        with self._lock:
            self._kept[key] = value
            self._kept.move_to_end(key)
            while len(self._kept) > self.size:
                self._kept.popitem(last=False)

    def invalidate(self, path: str) -> None:
        with self._lock:
            for key in [k for k in self._kept if k[0] == path]:
                del self._kept[key]

    def clear(self) -> None:
        with self._lock:
            self._kept.clear()

    def __len__(self) -> int:
        return len(self._kept)
