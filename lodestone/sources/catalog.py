"""Names of indexes and the tables behind them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AlreadyExists, InvalidArgument, NotFound

KV, INVERTED, SPATIAL = "kv", "inverted", "spatial"
_NEEDS = {KV: ("key", "value"), INVERTED: ("key", "value"), SPATIAL: ("key", "value", "min_x", "min_y", "max_x", "max_y")}


@dataclass(frozen=True)
class KeyCodec:
    """Keys that are a prefix and a zero-padded number of a native column.

    A bound on such a key is one on the number, which a Parquet scan can use.
    Numbers too long for the padding are let through to the test of the key.
    """

    prefix: str
    column: str
    width: int

    def encode(self) -> Column:
        return F.concat(F.lit(self.prefix), F.lpad(F.col(self.column).cast("string"), self.width, "0"))

    def number(self, key: str) -> int | None:
        digits = key.removeprefix(self.prefix)
        return int(digits) if key.startswith(self.prefix) and re.fullmatch(rf"[0-9]{{{self.width}}}", digits) else None

    def within(self, start: str) -> Column | None:
        """What keys that begin with ``start`` ask of the number; numbers too long for the padding go through."""
        digits = start.removeprefix(self.prefix)
        if not start.startswith(self.prefix) or not re.fullmatch(rf"[0-9]{{0,{self.width}}}", digits):
            return None
        c, unit = F.col(self.column), 10 ** (self.width - len(digits))
        low = int(digits or "0") * unit
        return ((c >= low) & (c < low + unit)) | (c >= 10**self.width) | (c < 0)

    def bound(self, op: str, key: str) -> Column | None:
        n = self.number(key)
        if n is None:
            return None
        c = F.col(self.column)
        test = {"=": c == n, "<": c < n, "<=": c <= n, ">": c > n, ">=": c >= n}.get(op)
        return None if test is None else test | (c >= 10**self.width) | (c < 0)


@dataclass
class IndexDef:
    """An index: its kind, its rows and, where the key is computed, how."""

    name: str
    kind: str
    rows: DataFrame
    postings: DataFrame | None = None
    codec: KeyCodec | None = None
    columns: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if self.kind not in _NEEDS:
            raise InvalidArgument(f"unknown kind of index: {self.kind}")
        missing = set(_NEEDS[self.kind]) - set(self.rows.columns)
        if missing:
            raise InvalidArgument(f"index {self.name} lacks {', '.join(sorted(missing))}")
        self.columns = self.columns or ("key", "value")


class Catalog:
    def __init__(self):
        self._indexes: dict[str, IndexDef] = {}

    def add(self, index: IndexDef, replace: bool = False) -> IndexDef:
        if index.name in self._indexes and not replace:
            raise AlreadyExists(f"index {index.name} exists")
        self._indexes[index.name] = index
        return index

    def get(self, name: str) -> IndexDef:
        """Lookup is by exact case."""
        if name not in self._indexes:
            raise NotFound(f"no index named {name}")
        return self._indexes[name]

    def drop(self, name: str) -> None:
        self.get(name)
        del self._indexes[name]

    def names(self) -> list[str]:
        return sorted(self._indexes)
