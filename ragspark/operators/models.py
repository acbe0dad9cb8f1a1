"""Models plugged in as callables: one for each worker process, kept over tasks, fed in batches of bounded length."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark import cloudpickle

#: Characters that a model gets at once, about.
BATCH_CHARS = 1 << 20
_kept: dict[str, object] = {}


def served(load: Callable[[], Callable]) -> Callable[[], Callable]:
    """load(), run once in a worker process: later tasks of that process, also of other jobs, get the same model.

    A model is known by what load() is, its code and what it holds, so another one is loaded beside it. Workers are kept
    over tasks unless spark.python.worker.reuse is off. A load that fails is tried again by the next task.
    """
    key = hashlib.sha256(cloudpickle.dumps(load)).hexdigest()

    def get() -> Callable:
        from ragspark.operators import models  # this process's own copy, whatever came with the closure

        if key not in models._kept:
            models._kept[key] = load()
        return models._kept[key]

    return get


def budgeted(texts: list[str], chars: int = BATCH_CHARS) -> Iterator[slice]:
    """Slices of texts with about so many characters each; a longer text is one by itself."""
    at, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > chars:
            yield slice(at, i)
            at, held = i, 0
        held += len(text)
    if at < len(texts):
        yield slice(at, len(texts))
