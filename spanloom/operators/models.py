"""The boundary to models: any callable on a batch may stand behind it. No model is part of this library."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class BatchModel(Protocol):
    """Takes inputs and returns as many outputs, or raises if it can't for this batch."""

    def __call__(self, batch: Sequence[str]) -> Sequence[str]: ...


def bisect(model: BatchModel, batch: list[str]) -> list[str | None]:
    """Outputs of a batch; a batch that fails is halved, and a single input that fails has no output."""
    try:
        out = list(model(batch))
        if len(out) == len(batch):
            return out
    except Exception:  # noqa: BLE001
        pass
    if len(batch) == 1:
        return [None]
    half = len(batch) // 2
    return bisect(model, batch[:half]) + bisect(model, batch[half:])


def one_by_one(model: BatchModel, batch: list[str]) -> list[str | None]:
    """Outputs of a batch; if it fails, each input is tried alone."""
    try:
        out = list(model(batch))
        if len(out) == len(batch):
            return out
    except Exception:  # noqa: BLE001
        pass
    return [x for t in batch for x in (bisect(model, [t]))]


def apply_model(df: DataFrame, column: str, output: str, factory: Callable[[], BatchModel], size: int = 8, retry: Callable[[BatchModel, list[str]], list[str | None]] = bisect) -> DataFrame:
    """Adds ``output``: the model's answer to ``column``, null where it has none or the input is null.

    The model is made once per task by ``factory``; batches have ``size`` rows of a partition, in its order.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for f in frames:
            todo = [i for i, v in enumerate(f[column]) if isinstance(v, str)]
            out: list[str | None] = [None] * len(f)
            for k in range(0, len(todo), size):
                part = todo[k : k + size]
                for i, v in zip(part, retry(model, [f[column].iloc[i] for i in part])):
                    out[i] = v
            yield f.assign(**{output: out})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{fields}, `{output}` string")


def language_trust(scores: dict[str, float], letters: int, least_letters: int = 12, least: float = 0.65, margin: float = 0.15) -> str:
    """The best language of a classifier, or ``und``: too few letters, too low a score or too close a second."""
    best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:2]
    if letters < least_letters or not best or best[0][1] < least or len(best) > 1 and best[0][1] - best[1][1] < margin:
        return "und"
    return best[0][0]


def gave_up(segments: Sequence[tuple[float, float, float]]) -> bool:
    """Whether any (temperature, mean log probability, compression) shows that a recogniser gave up."""
    return any(t >= 1.0 and (lp < -1 or c > 2.4) for t, lp, c in segments)
