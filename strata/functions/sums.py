"""Content sums: spelling, prefix keys, element digests and their XOR.

A sum is 32 bytes. Tables spell it as hex digits in any letter case with blanks anywhere, and may
shorten a reference to 32 or more leading digits. Inside the engine a state is keyed by its first
16 bytes as BINARY, half the size of the shortest spelling.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.layout import spread

BLANKS = " \t\n\r\x0b\x0c\xa0   　"
LANES = ("lane0", "lane1", "lane2", "lane3")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digits(c: Column | str) -> Column:
    """Upper-case digits without blanks; NULL stays NULL."""
    return F.upper(F.translate(col(c), BLANKS, ""))


def state_key(c: Column | str) -> Column:
    """First 16 bytes of a sum or of a shortened reference; NULL for fewer than 32 digits or none."""
    d = digits(c)
    return F.when(F.length(d) >= 32, F.unhex(F.substring(d, 1, 32)))


def sum_bytes(c: Column | str) -> Column:
    """The 32 bytes of a full sum; NULL where it is not 64 hex digits."""
    d = digits(c)
    return F.when(F.length(d) == 64, F.unhex(d))


def sum_text(c: Column | str, pairs: bool = False) -> Column:
    """Bytes as upper-case digits, optionally in blank-separated pairs."""
    text = F.hex(col(c))
    return F.regexp_replace(text, "(..)(?!$)", "$1 ") if pairs else text


def short_text(c: Column | str) -> Column:
    """The first 16 bytes only, for display."""
    return F.substring(F.hex(col(c)), 1, 32)


def matches_prefix(sum_: Column | str, text: Column | str) -> Column:
    """Does the sum begin with these hex digits? More than 64 digits never match, an odd count may."""
    d = digits(text)
    return (F.length(d) <= 64) & F.startswith(digits(sum_), d)


def lanes(hex_or_bytes: Column, is_hex: bool = True) -> list[Column]:
    """A 32-byte sum as four BIGINT lanes, two's complement, for hash aggregation with bit_xor."""
    text = hex_or_bytes if is_hex else F.hex(hex_or_bytes)
    return [
        F.conv(F.substring(text, 1 + 16 * i, 16), 16, -10).cast("bigint").alias(name)
        for i, name in enumerate(LANES)
    ]


def lanes_text(*cols: Column | str) -> Column:
    """Four lanes back to 64 upper-case digits."""
    return F.concat(*[F.lpad(F.hex(col(c)), 16, "0") for c in cols])


def element_digest(elt_id: Column | str, payload: Column | str) -> Column:
    """Built-in digest of (id as 8 bytes big-endian, payload) as lower-case digits; a NULL payload is marked apart from ''."""
    mark = F.when(col(payload).isNull(), F.lit("N")).otherwise(F.concat(F.lit("P"), col(payload).cast("string")))
    return F.sha2(F.concat(F.lpad(F.hex(col(elt_id)), 16, "0"), mark), 256)


def blake2(elt_id: int, data: bytes) -> bytes:
    return hashlib.blake2b((elt_id & (2**64 - 1)).to_bytes(8, "big") + data, digest_size=32).digest()


@F.pandas_udf(T.BinaryType())
def element_blake2(ids: pd.Series, data: pd.Series) -> pd.Series:
    """BLAKE2b-256 of (id as 8 bytes big-endian, data), as the binary format has it."""
    return pd.Series([None if d is None else blake2(int(i), bytes(d)) for i, d in zip(ids, data)], dtype=object)


def meta_digest(number: int, timestamp: int, parents: list[bytes], extra: str | None = None) -> bytes:
    """Digest of a commit's metadata: number, time, parents in order and text; flags are not covered."""
    h = hashlib.blake2b(digest_size=32)
    h.update(b"CNUM" + number.to_bytes(4, "big") + timestamp.to_bytes(8, "big", signed=True))
    for p in parents:
        h.update(p)
    if extra is not None:
        h.update(extra.encode())
    return h.digest()


def xor_bytes(a: bytes, b: bytes) -> bytes:
    return bytes(x ^ y for x, y in zip(a, b, strict=True))


def state_sum(elements, digest: Column | None = None):
    """XOR of the element digests of (elt_id, elt): one row of four lanes and the count."""
    d = digest if digest is not None else element_digest("elt_id", "elt")
    return (
        spread(elements).select(d.alias("_d"))
        .select(*lanes(F.col("_d")))
        .agg(*[F.coalesce(F.bit_xor(x), F.lit(0)).alias(x) for x in LANES], F.count(F.lit(1)).alias("n_elements"))
        .select(lanes_text(*LANES).alias("elt_sum"), "n_elements")
    )
