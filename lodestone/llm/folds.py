"""The fold of documents that no model learns from, samples to learn from, and sized broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by five (a null id: no)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def learnable(id_col: str = "doc_id") -> Column:
    """Whether a model may learn from the row; a row without id is in neither fold."""
    return F.col(id_col).isNotNull() & ~held_out(id_col)


#: A sample's rows are asked for with this margin, and then cut to its size.
MARGIN = 1.5
_STEPS = 1 << 30


def place(*cols: str) -> Column:
    """A document's place in all samples: an even hash of its id (and what else is named), from 0 to 1."""
    return F.pmod(F.xxhash64(*map(F.col, cols)), F.lit(_STEPS)) / _STEPS


def share(wanted: int, there: int) -> float:
    """Up to which place a sample of ``wanted`` of ``there`` rows reaches, with a margin."""
    return min(1.0, MARGIN * wanted / max(1, there))


#: Rows of a few numbers and a name that may be broadcast.
BROADCAST_ROWS = 500_000


def bounded(small: DataFrame, limit: int | None = None) -> DataFrame:
    """Broadcast only what was counted and is within the limit."""
    limit = BROADCAST_ROWS if limit is None else limit
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small


def fresh(name: str, df: DataFrame) -> str:
    """``name``, with as many underscores as tell it from every column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
