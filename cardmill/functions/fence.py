"""Keep costly columns from being computed again by filters and later steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill.functions.values import backticked


def fence(cards: DataFrame, *names: str) -> DataFrame:
    """The same rows, with the named columns put last and computed exactly once.

    The optimizer moves a filter below the projection it stands on and repeats the
    projected expression in it. For a parsed, converted or validated card that means
    doing the work twice, or once per reference. A one-row inline, like a lateral
    join, gives the columns as they are but is not looked through. It stays in the
    same stage and adds no shuffle.
    """
    others = [F.col(backticked(name)) for name in cards.columns if name not in names]
    fixed = F.struct(*[F.col(backticked(name)) for name in names])
    return cards.select(*others, F.inline(F.array(fixed)))
