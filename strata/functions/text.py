"""Small functions over bytes and strings: rendering, trimming, names of files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of snapshot and log files; the base name may be missing.
SNAPSHOT_NAME = r"^(?:(.*)-)?ss(0|[1-9][0-9]*)\.pip$"
LOG_NAME = r"^(?:(.*)-)?ss(0|[1-9][0-9]*)-cl(0|[1-9][0-9]*)\.piplog$"


def escaped(data: bytes) -> str:
    """Printable ASCII as it is, backslash and quotes escaped, any other byte as \\xNN."""
    out = []
    for b in data:
        c = chr(b)
        out.append("\\" + c if c in "\\\"'" else c if 0x20 <= b < 0x7F else f"\\x{b:02X}")
    return "".join(out)


def hex_dump(data: bytes, width: int = 16) -> str:
    """Lines of hex pairs with the text beside them; control characters and blanks show as a dot."""
    lines = []
    for i in range(0, len(data), width):
        part = data[i : i + width]
        pairs = " ".join(f"{b:02X}" for b in part).ljust(3 * width - 1)
        lines.append(pairs + "  " + "".join(chr(b) if 0x20 < b < 0x7F else "." for b in part))
    return "\n".join(lines)


@F.pandas_udf(T.StringType())
def escaped_udf(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else escaped(bytes(x)))


@F.pandas_udf(T.StringType())
def hex_dump_udf(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else hex_dump(bytes(x)))


def rtrim(values: Column, what) -> Column:
    """An array without its trailing elements equal to ``what``."""
    last = F.aggregate(
        F.transform(values, lambda x, i: F.when(x.eqNullSafe(F.lit(what)), F.lit(0)).otherwise(i + 1)), F.lit(0), lambda a, x: F.greatest(a, x)
    )
    return F.slice(values, 1, last)


def text_or_bytes(data: Column) -> Column:
    """UTF-8 as text, anything else as bytes: a struct of which one field is set."""
    text = F.try_validate_utf8(data.cast("string"))
    return F.struct(text.alias("str"), F.when(text.isNull(), data).alias("bin"))


def version_of(digits: Column) -> Column:
    """ASCII digits as a number, 0 if there is anything else."""
    return F.coalesce(F.when(digits.rlike("^[0-9]+$"), digits.try_cast("int")), F.lit(0))


def padding(length: Column) -> Column:
    """Zero bytes up to the next boundary of 16."""
    return F.pmod(-length, F.lit(16))


def file_parts(name: Column) -> Column:
    """(basename, ss, cl, kind) of a snapshot or log file's name; kind is NULL for other files."""
    is_ss, is_cl = name.rlike(SNAPSHOT_NAME), name.rlike(LOG_NAME)
    part = lambda i: F.when(is_ss, F.regexp_extract(name, SNAPSHOT_NAME, i) if i < 3 else None).when(is_cl, F.regexp_extract(name, LOG_NAME, i))
    return F.struct(
        part(1).alias("basename"), part(2).cast("bigint").alias("ss"), F.when(is_cl, F.regexp_extract(name, LOG_NAME, 3)).cast("bigint").alias("cl"),
        F.when(is_ss, "snapshot").when(is_cl, "log").alias("kind"),
    )
