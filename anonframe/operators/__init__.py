"""Operators over several private frames; those over one or two are methods of ``PrivateFrame``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frame import PrivateFrame


def merge_partials(*partials: PrivateFrame, keys: list[str], sums: list[str]) -> PrivateFrame:
    """One table from owners' partial sums and counts."""
    both = partials[0]
    for p in partials[1:]:
        both = both.union(p)
    return PrivateFrame(both.reveal().groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]))
