"""Values of the key-value view: limits, scores, wrapped texts, sealing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the API.
MAX_KEY_BYTES = 1024
MAX_VALUE_BYTES = 16384
MAX_BULK = 10000
MAX_RANGE = 10000


def problems(key: Column, value: Column) -> Column:
    """Array of what is wrong with a pair; empty where nothing is."""
    checks = (
        (key.isNull() | (key == ""), "key is empty"),
        (F.octet_length(key) > MAX_KEY_BYTES, "key is too long"),
        (F.octet_length(value) > MAX_VALUE_BYTES, "value is too long"),
    )
    return F.array_compact(F.array(*(F.when(bad, F.lit(text)) for bad, text in checks)))


def number(value: Column) -> Column:
    """The value as a double, null where it isn't one."""
    return value.try_cast("double")


def score_text(score: Column) -> Column:
    return F.format_string("%.6f", score)


def wrapped_text(value: Column) -> Column:
    """The inside of a value written as NAME.TEXT(...), which is stored and text-indexed; null for any other."""
    inside = F.regexp_extract(value, r"(?s)^\w+\.TEXT\((.*)\)$", 1)
    return F.when(F.regexp_like(value, F.lit(r"(?s)^\w+\.TEXT\(.*\)$")), inside)


def seal(data: Column, key: str) -> Column:
    """AES-GCM with a random nonce in front."""
    return F.aes_encrypt(data, F.lit(key), F.lit("GCM"))


def unseal(data: Column, key: str) -> Column:
    return F.aes_decrypt(data, F.lit(key), F.lit("GCM"))


def checksum(data: Column) -> Column:
    return F.sha2(data, 256)
