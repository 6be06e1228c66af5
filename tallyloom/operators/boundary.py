"""Calls of outside models in batches: items go to a callable some at a time, answers are checked, and only what failed is
asked again, alone at last; what still fails takes a default."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

Answerer = Callable[[list[str]], list[str | None]]


def classified(items: DataFrame, key: str, text: str, answer: Answerer, allowed: set[str], default: str, batch: int = 20, retries: int = 1) -> DataFrame:
    """key and label of each item. `answer` takes prompts and gives a label or None for each; it may raise."""

    def ask(prompts: list[str]) -> list[str | None]:
        try:
            got = answer(prompts)
        except Exception:  # noqa: BLE001  the provider's failure is an answer too
            return [None] * len(prompts)
        return [a if a in allowed else None for a in [*got, *[None] * len(prompts)][: len(prompts)]]

    def run(batches):
        for rows in batches:
            keys, prompts = rows.column(key), rows.column(text).to_pylist()
            labels: list[str | None] = []
            for lo in range(0, len(prompts), batch):
                part = prompts[lo : lo + batch]
                got = ask(part)
                for _ in range(retries):
                    if failed := [i for i, a in enumerate(got) if a is None]:
                        for i, a in zip(failed, ask([part[i] for i in failed]), strict=True):
                            got[i] = a
                for i, a in enumerate(got):
                    if a is None:
                        got[i] = ask([part[i]])[0] or default
                labels += got
            yield pa.RecordBatch.from_arrays([keys, pa.array(labels, pa.string())], [key, "label"])

    kind = dict(items.dtypes)[key]
    return items.select(key, text).mapInArrow(run, f"{key} {kind}, label string")


def answered(items: DataFrame, keys: list[str], prompt: str, answer: Answerer, batch: int = 20) -> DataFrame:
    """keys and answer of each item: a prompt goes out with others of its batch, and alone if the batch fails; null where that fails
    too, or where the prompt is null. The caller writes the result if it is read twice, as each reading calls again."""

    def ask(prompts: list[str]) -> list[str | None]:
        try:
            got = list(answer(prompts))
            if len(got) == len(prompts):
                return got
        except Exception:  # noqa: BLE001  the provider's failure is an answer too
            pass
        return [None] if len(prompts) == 1 else [ask([p])[0] for p in prompts]

    def run(batches):
        for rows in batches:
            prompts = rows.column(prompt).to_pylist()
            got: list[str | None] = [None] * len(prompts)
            wanted = [i for i, p in enumerate(prompts) if p is not None]
            for lo in range(0, len(wanted), batch):
                part = wanted[lo : lo + batch]
                for i, a in zip(part, ask([prompts[i] for i in part]), strict=True):
                    got[i] = a
            yield pa.RecordBatch.from_arrays([*[rows.column(k) for k in keys], pa.array(got, pa.string())], [*keys, "answer"])

    schema = items.select(*keys).schema.add("answer", "string")
    return items.select(*keys, prompt).mapInArrow(run, schema)
