"""Helpers for small, bounded result frames (top-k lists, one-row summaries)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_TAG = "_scalar_row"


def spread(rows: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach the columns of a one-row ``scalars`` frame to every row of ``rows``.

    Only for ``rows`` of bounded size (a top-k list): the two frames are
    unioned and the scalar values spread by a window over the union.
    """
    rtypes = dict(rows.dtypes)
    stypes = dict(scalars.dtypes)
    left = rows.select(
        *[F.col(c) for c in rows.columns],
        *[F.lit(None).cast(stypes[c]).alias(c) for c in scalars.columns],
        F.lit(False).alias(_TAG),
    )
    right = scalars.select(
        *[F.lit(None).cast(rtypes[c]).alias(c) for c in rows.columns],
        *[F.col(c) for c in scalars.columns],
        F.lit(True).alias(_TAG),
    )
    whole = Window.partitionBy()
    return (
        left.unionByName(right)
        .select(
            *rows.columns,
            *[F.max(c).over(whole).alias(c) for c in scalars.columns],
            _TAG,
        )
        .where(~F.col(_TAG))
        .drop(_TAG)
    )
