"""Model services behind one protocol, called on the executors in Arrow batches."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Provider(Protocol):
    """A service for one kind of call. A request that fails gives None. Calls may be repeated after a task is lost."""

    def healthy(self) -> bool: ...

    def call(self, requests: Sequence[dict[str, Any]]) -> list[dict[str, Any] | None]: ...


class StubProvider:
    """Deterministic answers from a hash of the request, for tests and dry runs. field: the answer's name."""

    def __init__(self, field: str = "text", fail_every: int = 0):
        self.field, self.fail_every = field, fail_every

    def healthy(self) -> bool:
        return True

    def call(self, requests: Sequence[dict[str, Any]]) -> list[dict[str, Any] | None]:
        out: list[dict[str, Any] | None] = []
        for r in requests:
            h = hashlib.sha256(repr(sorted(r.items())).encode()).hexdigest()
            out.append(None if self.fail_every and int(h[:8], 16) % self.fail_every == 0 else {self.field: h[:16]})
        return out


class EnergyVad:
    """Speech segments of samples: stretches whose loudness passes a threshold, short gaps closed, short bursts dropped."""

    def __init__(self, threshold: float = 0.02, min_speech_ms: int = 250, min_silence_ms: int = 300, step_ms: int = 10):
        self.threshold, self.min_speech_ms, self.min_silence_ms, self.step_ms = threshold, min_speech_ms, min_silence_ms, step_ms

    def healthy(self) -> bool:
        return True

    def call(self, requests: Sequence[dict[str, Any]]) -> list[dict[str, Any] | None]:
        import numpy as np

        out: list[dict[str, Any] | None] = []
        for r in requests:
            x, step = np.abs(np.asarray(r["pcm"], np.float32)), max(1, int(r["sample_rate"]) * self.step_ms // 1000)
            loud = np.maximum.reduceat(x, np.arange(0, len(x), step)) > self.threshold if len(x) else np.empty(0, bool)
            edge = np.flatnonzero(np.diff(np.concatenate(([0], loud.astype(np.int8), [0]))))
            spans = [[a * self.step_ms, b * self.step_ms] for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
            joined: list[list[int]] = []
            for s in spans:
                if joined and s[0] - joined[-1][1] < self.min_silence_ms:
                    joined[-1][1] = s[1]
                else:
                    joined.append(s)
            total = len(x) * 1000 // int(r["sample_rate"])
            kept = [(a, min(b, total)) for a, b in joined if min(b, total) - a >= self.min_speech_ms]
            out.append({"starts": [a for a, _ in kept], "ends": [b for _, b in kept]})
        return out


def enrich(df: DataFrame, provider: Provider, inputs: Sequence[str], result: str, calls_at_once: int | None = None, retries: int = 2, pause_s: float = 0.0, batch: int = 32) -> DataFrame:
    """df with the provider's answers in columns (result: their schema). A request that fails to the end gives nulls.

    calls_at_once bounds the tasks that call; pause_s is waited between the calls of one task. A service that isn't
    healthy raises before the first call.
    """
    from pyspark.sql.types import StructType

    answer = StructType.fromDDL(result)
    out = StructType([*df.schema.fields, *answer.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        checked = False
        for pdf in batches:
            if not checked and not provider.healthy():
                raise RuntimeError("the service is not healthy")
            checked = True
            requests = pdf[list(inputs)].to_dict("records")
            answers: list[dict[str, Any] | None] = [None] * len(requests)
            for low in range(0, len(requests), batch):
                todo = list(range(low, min(low + batch, len(requests))))
                for attempt in range(retries + 1):
                    got = provider.call([requests[i] for i in todo])
                    for i, a in zip(todo, got):
                        answers[i] = a
                    todo = [i for i in todo if answers[i] is None]
                    if not todo:
                        break
                    if pause_s:
                        time.sleep(pause_s * 2**attempt)
            for f in answer.names:
                pdf[f] = [None if a is None else a.get(f) for a in answers]
            yield pdf[out.names]

    source = df.repartition(calls_at_once) if calls_at_once else df
    return source.mapInPandas(run, out)
