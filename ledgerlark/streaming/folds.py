"""Folds over the ordered rows of each key, in memory that a key's number of rows doesn't raise."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(
    rows: DataFrame, key: str, order: list[str], schema: str, start: Callable[[], Any], step: Callable[[Any, Any], tuple | None], finish: Callable[[Any, Any], tuple] | None = None,
) -> DataFrame:
    """Rows of ``schema``: what ``step(state, row)`` gives for each row, in order within its key, and ``finish(key, state)`` after a key's last row.

    ``start()`` makes a key's state, which ``step`` changes. Rows are dealt by key and sorted, which spills to disk; a task then goes through
    them batch by batch and holds one state. A key's rows are one task's, as a fold has an order, but never a group in memory.
    Steps that give None write nothing.
    """
    names = [f.split()[0] for f in schema.split(", ")]
    columns = rows.columns

    def run(parts):
        current, state, fresh = None, None, True
        for part in parts:
            out = []
            for row in part.itertuples(index=False, name=None):
                found = dict(zip(columns, row, strict=True))
                own = found[key]
                if fresh or own != current:
                    if not fresh and finish is not None:
                        out.append(finish(current, state))
                    current, state, fresh = own, start(), False
                made = step(state, found)
                if made is not None:
                    out.append(made)
            yield pd.DataFrame(out, columns=names, dtype=object)
        if not fresh and finish is not None:
            yield pd.DataFrame([finish(current, state)], columns=names, dtype=object)

    return rows.filter(f"`{key}` IS NOT NULL").repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
