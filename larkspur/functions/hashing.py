"""Repeatable random numbers: a value depends on seed, stream and row number only.

They do not depend on partitioning or on the order of execution, so a lost task that runs again
gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int, stream: str, *ids: Column) -> Column:
    """32 hexadecimal digits for one row of one stream."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *[i.cast("string") for i in ids]))


def draw(hex_digits: Column, part: int) -> Column:
    """One of the four 32-bit numbers in a digest (part 0 to 3)."""
    return F.conv(F.substring(hex_digits, 8 * part + 1, 8), 16, 10).cast("bigint")


def wide_draw(hex_digits: Column) -> Column:
    """A 60-bit number, for a pick among more choices than 32 bits cover evenly."""
    return F.conv(F.substring(hex_digits, 1, 15), 16, 10).cast("bigint")


def pick(values: tuple, number: Column) -> Column:
    """The entry of ``values`` that ``number`` selects."""
    choices = F.array(*[F.lit(v) for v in values])
    return F.element_at(choices, (number % len(values) + 1).cast("int"))


def pick_by_threshold(number: Column, choices: list[tuple[int, str]]) -> Column:
    """The first choice whose threshold lies above ``number``; thresholds ascend."""
    chosen = F.when(number < choices[0][0], choices[0][1])
    for threshold, value in choices[1:]:
        chosen = chosen.when(number < threshold, value)
    return chosen
