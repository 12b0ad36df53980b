"""Key encodings that keep order, and ranges that Parquet can use.

Keys are byte strings in unsigned order, the shorter first among equals; strings work too, by their UTF-8 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of the data model.
MAX_KEY = 1344
MAX_VALUE = 1 << 20
MAX_PREFIX = 32
MAX_STORES = 256
#: Binary multipliers of the letters after a size, in either case.
SIZE_UNITS = {"": 1, "k": 2**10, "m": 2**20, "g": 2**30, "t": 2**40, "p": 2**50, "e": 2**60}


def decimal_key(number: Column, width: int = 10) -> Column:
    """Non-negative number as zero-padded decimal digits."""
    return F.lpad(number.cast("string"), width, "0")


def u64_key(*numbers: Column) -> Column:
    """Non-negative numbers as big-endian 64-bit segments."""
    return F.unhex(F.concat(*[F.lpad(F.hex(n.cast("long")), 16, "0") for n in numbers]))


def successor(prefix: bytes) -> bytes | None:
    """The least byte string above all that begin with prefix; None if there is none."""
    stem = prefix.rstrip(b"\xff")
    return stem[:-1] + bytes([stem[-1] + 1]) if stem else None


def prefix_range(key: Column, prefix: bytes | str) -> Column:
    """key begins with prefix. As two comparisons for bytes, which reach the scan where a binary startswith does not."""
    if isinstance(prefix, str):
        return key.startswith(prefix)
    after = successor(prefix)
    low = key >= F.lit(prefix)
    return low if after is None else low & (key < F.lit(after))


def key_range(key: Column, low=None, high=None, closed: bool = True) -> Column:
    """low <= key <= high, or key < high if not closed; a bound that is None is open."""
    out = F.lit(True)
    if low is not None:
        out = out & (key >= F.lit(low))
    if high is not None:
        out = out & ((key <= F.lit(high)) if closed else (key < F.lit(high)))
    return out


def parse_size(text: Column) -> Column:
    """Bytes of a size such as "64", "10k" or "1 G"; null if it is none or more than a long holds.

    Digits are decimal, or hexadecimal after 0x, or octal after 0. One letter may follow, with spaces around it, and nothing else.
    """
    parts = r"^\s*([1-9][0-9]*|0[xX][0-9a-fA-F]+|0[0-7]*)\s*([kmgtpeKMGTPE]?)\s*$"
    units = F.create_map(*[x for k, v in SIZE_UNITS.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    digits, unit = F.regexp_extract(text, parts, 1), F.lower(F.regexp_extract(text, parts, 2))
    hexa, octal = F.lower(digits).startswith("0x"), digits.startswith("0")
    # Numbers of more digits than a long can have would wrap round or stop at the greatest in conv.
    number = (
        F.when(hexa & digits.rlike("^0.0*[0-9a-fA-F]{1,16}$"), F.conv(F.substring(digits, 3, 1 << 30), 16, 10))
        .when(~hexa & octal & digits.rlike("^0*[0-7]{0,21}$"), F.conv(digits, 8, 10))
        .when(~octal & (digits != ""), digits)
    )
    return F.try_multiply(number.try_cast("long"), units[unit])
