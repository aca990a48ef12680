"""The fold that is held out when a model is learnt."""

from pyspark.sql import Column, functions as F

FOLDS = 5


def fold(doc_id: Column) -> Column:
    """``crc32(id as text) mod 5``; a NULL id counts as 0, that is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)), F.lit(0)).cast("int")
