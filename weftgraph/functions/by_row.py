"""Python functions of one text, a few rows at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def by_row(function: Callable[[str], str]) -> Callable[..., Column]:
    """A function of texts as one of columns; null stays null.

    Texts may be long, and an Arrow batch has 10,000 of them whatever their
    length, with its copies as pandas and Python objects.  Rows go to Python in
    batches of a hundred here, so that its memory doesn't grow with the table.
    """
    return F.udf(lambda text: None if text is None else function(text), StringType(), useArrow=False)
