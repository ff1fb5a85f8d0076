"""The dot-joined series key and its eleven segments."""

from pyspark.sql import Column, functions as F

from seriesforge.model import DIMENSIONS

WIDTH = len(DIMENSIONS)


def segments(key: Column) -> Column:
    return F.split(key, r"\.")


def segment(key: Column, dimension: str) -> Column:
    """One segment; NULL when the key is too short."""
    return F.try_element_at(segments(key), F.lit(DIMENSIONS.index(dimension) + 1))


def join_key(parts) -> Column:
    """Dot-joined key, NULL when any part is NULL so that no short key comes out."""
    pieces = []
    for part in parts:
        pieces += [F.lit("."), part]
    return F.concat(*pieces[1:])


def is_malformed(key: Column) -> Column:
    """True for a NULL key or one without exactly eleven segments."""
    return F.coalesce(F.size(segments(key)) != WIDTH, F.lit(True))

