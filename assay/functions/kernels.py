"""The seam for kernels that Spark lacks: parsers, matchers, models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from .joins import dealt


def evaluated(rows: DataFrame, kernel: Callable, names: list[str], schema: str, error: str = "oracle_error") -> DataFrame:
    """``kernel`` (pandas frame -> frame with columns ``names`` of ``schema``) over ``rows``, in batches.

    A batch that raises is halved until the rows that raise stand alone; such a
    row keeps the columns it came with, has nulls for the others and its error
    in ``error``, so it never fails the job. Where many rows raise, the next
    batch is cut into pieces of which about half hold none that does. Rows are
    dealt to tasks anew, as a kernel's work follows their number, not their bytes.
    """

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        size = None
        for frame in frames:
            n = len(frame)
            step = size or max(n, 1)
            open_ = [(at, min(at + step, n)) for at in range(0, n, step)]
            good, bad, messages = [], [], []
            while open_:
                low, high = open_.pop()
                try:
                    good.append(kernel(frame.iloc[low:high]))
                except Exception as e:  # noqa: BLE001 - whatever an external kernel raises
                    if high - low > 1:
                        half = (low + high) // 2
                        open_ += [(low, half), (half, high)]
                    else:
                        bad.append(low)
                        messages.append(f"{type(e).__name__}: {e}")
            size = max(1, n // (2 * len(bad))) if bad else None
            if good:
                yield pd.concat(good, ignore_index=True).assign(**{error: None})[[*names, error]]
            if bad:
                kept = frame.iloc[bad]
                yield pd.DataFrame({c: kept[c].tolist() if c in frame else [None] * len(bad) for c in names}).assign(**{error: messages})[[*names, error]]

    return dealt(rows).mapInPandas(run, f"{schema}, {error} string")
