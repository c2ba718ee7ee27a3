"""Key hashes and slots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Routing depends on exactly these.
CRC_SLOTS = 8
FNV_SLOTS = 16384
FNV_BASIS = 2166136261
FNV_PRIME = 16777619


def slot_crc32(key: Column, slots: int = CRC_SLOTS) -> Column:
    """CRC-32 (IEEE) of the UTF-8 bytes, modulo slots."""
    return F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(slots)).cast("int")


def fnv1a_32(key: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, 32 bits, as a long."""
    data = F.encode(key, "UTF-8")
    places = F.when(F.octet_length(key) > 0, F.sequence(F.lit(1), F.octet_length(key))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long")
    return F.aggregate(places, F.lit(FNV_BASIS).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def slot_fnv(key: Column, slots: int = FNV_SLOTS) -> Column:
    return F.pmod(fnv1a_32(key), F.lit(slots)).cast("int")


def slot_range(text: Column, slots: int = FNV_SLOTS) -> Column:
    """struct(first, last) of "a-b" or "a", both inclusive; null where it isn't a range of the slots."""
    part = F.split(F.trim(text), "-")
    first = F.get(part, F.lit(0)).try_cast("int")
    last = F.coalesce(F.get(part, F.lit(1)), F.get(part, F.lit(0))).try_cast("int")
    ok = (F.size(part) <= 2) & (first >= 0) & (last >= first) & (last < slots)
    return F.when(ok, F.struct(first.alias("first"), last.alias("last")))
