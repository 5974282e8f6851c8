"""Column expressions that read numbers, hardware addresses and checksums out of a binary column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _offset(at: int | Column) -> Column:
    return F.lit(at) if isinstance(at, int) else at


def unsigned(data: Column, at: int | Column, size: int) -> Column:
    """The big-endian unsigned number of ``size`` (at most 7) bytes that starts at byte ``at``, as a long."""
    piece = F.substring(data, _offset(at) + 1, F.lit(size))
    return F.conv(F.hex(piece), 16, 10).cast("long")


def colon_hex(data: Column, at: int, size: int) -> Column:
    """``size`` bytes as two lower-case digits each with colons between, the notation of hardware addresses."""
    digits = F.lower(F.hex(F.substring(data, at + 1, size)))
    return F.concat_ws(":", *[F.substring(digits, 2 * i + 1, 2) for i in range(size)])


def word_sum(data: Column, at: int | Column, size: int | Column) -> Column:
    """Sum that leaves the same remainder by 65535 as the sum of the 16-bit words of ``data[at:at+size]``.

    65536 leaves remainder 1, so six bytes can be taken as one number: a third of the steps. A last
    piece that is shorter is padded with zero bytes on the right.
    """
    size = _offset(size)
    steps = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(6))

    def add(total: Column, i: Column) -> Column:
        piece = F.hex(F.substring(data, _offset(at) + i + 1, F.least(F.lit(6), size - i)))
        return total + F.conv(F.rpad(piece, 12, "0"), 16, 10).cast("long")

    return F.when(size > 0, F.aggregate(steps, F.lit(0).cast("long"), add)).otherwise(F.lit(0).cast("long"))


def ones_complement(total: Column) -> Column:
    """The internet checksum (RFC 1071) of words whose sum is ``total``: end-around carry, then complement."""
    folded = F.when(total == 0, F.lit(0)).when(total % 65535 == 0, F.lit(65535)).otherwise(total % 65535)
    return (F.lit(65535) - folded).cast("int")
