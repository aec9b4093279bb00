"""Bounded groups handed to Arrow functions many at a time, so that a small group doesn't cost a call of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def by_whole_groups(df: DataFrame, keys: Sequence[str], run: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` gets rows of one or more whole groups and the number of each row's group, rising from 0; null is a key like any other.

    Groups stream by in the order of their keys; a task holds those of a batch, and one that is larger than a batch alone.
    """
    keys = list(keys)

    def numbers(pdf: pd.DataFrame) -> np.ndarray:
        return pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()

    def handed(pieces: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(pieces, ignore_index=True) if len(pieces) > 1 else pieces[0].reset_index(drop=True)
        return run(pdf, numbers(pdf))

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for part in parts:
            if not len(part):
                continue
            start = int(np.argmax((own := numbers(part)) == own[-1]))  # where its last group begins, of which the next batch may have more
            if start:
                yield handed([*held, part.iloc[:start]])
                held = [part.iloc[start:]]
            elif held and numbers(pd.concat([held[-1].iloc[-1:], part.iloc[:1]], ignore_index=True))[-1]:
                yield handed(held)
                held = [part]
            else:
                held.append(part)
        if held:
            yield handed(held)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(batches, schema)
