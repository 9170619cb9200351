"""Array helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def items(array: Column | str) -> Column:
    """The array, for use in ``explode``.

    For a bare column Spark infers ``size(array) > 0`` and pushes it below the projection that computes
    the array, which then is computed again for the test.  A copy of the references prevents that.
    """
    return F.transform(array, lambda x: x)
