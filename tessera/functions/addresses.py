"""Addresses of packs as offsets into an image; null where they fit nowhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first address that a map may have, the longest map, and the largest address.
LEAST, LONGEST, LARGEST = 0x80, 64 << 20, 0xFFFFFFFF


def _within(begin: Column, end: Column, base: Column, size: Column) -> Column:
    """The offset of a stretch in an image of ``size`` bytes that is named by offsets or, from a base other than 0, by addresses."""
    return F.when(end <= size, begin).when((base != 0) & (begin >= base) & (end <= base + size), begin - base)


def map_offset(begin: Column, end: Column, limit: Column, base: Column, size: Column) -> Column:
    """The offset of a map from ``begin`` to ``end``: in an image of ``size`` bytes or, if that is 0, below the pack's own ``limit``."""
    good = (begin >= LEAST) & (end > begin) & (end - begin <= LONGEST) & (limit != 0) & (limit != LARGEST)
    alone = F.when(end <= limit, begin)  # without an image, a pack's limit is often its size
    return F.when(good, F.when(size > 0, _within(begin, end, base, size)).otherwise(alone))


def axis_offset(begin: Column, count: Column, width: Column, base: Column, size: Column) -> Column:
    """The offset of ``count`` points of ``width`` bytes; without an image (size 0) whatever the base leaves."""
    end = begin + count * width
    good = (begin != 0) & (count > 0) & (width > 0) & (end <= LARGEST + 1)
    alone = F.when((base != 0) & (begin >= base), begin - base).otherwise(begin)
    return F.when(good, F.when(size == 0, alone).otherwise(_within(begin, end, base, size)))
