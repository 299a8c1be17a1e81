"""Hook for an external scorer: the one place where Python sees rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Scorer = Callable[[str], str]

RESULT_FIELDS = (
    T.StructField("output", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("error", T.StringType()),
    T.StructField("elapsed_ms", T.DoubleType()),
)


def score_batch(prompts: DataFrame, make_scorer: Callable[[], Scorer],
                read_label: Callable[[str], int | None], prompt: str = "prompt",
                fallback: str | None = None, attempts: int = 1) -> DataFrame:
    """Add output, label, error and elapsed time per prompt.

    ``make_scorer`` runs once per partition (a client, a loaded model); batches
    arrive through Arrow. A failing row records its error and does not stop
    the others. When the answer has no verdict and a ``fallback`` prompt column
    is named, that prompt is tried once more.
    """
    schema = T.StructType([*prompts.schema.fields, *RESULT_FIELDS])

    def ask(scorer: Scorer, text: str) -> tuple[str, str]:
        problem = ""
        for attempt in range(1, attempts + 1):
            try:
                answer = scorer(text)
                if answer:
                    return answer, ""
                problem = f"empty response on attempt {attempt}"
            except Exception as exc:  # noqa: BLE001 - isolated per row
                problem = f"attempt {attempt}: {exc}"
        return "", problem

    def score_row(scorer: Scorer, first: str, second: str | None) -> tuple:
        began = time.perf_counter()
        output, error = ask(scorer, first)
        label = read_label(output)
        if label is None and second is not None:
            again, problem = ask(scorer, second)
            label, output = read_label(again), again or output
            if label is None:
                problem = ": ".join(p for p in ("fallback failed", problem) if p)
                error = " | ".join(p for p in (error, problem) if p)
        return output, label, error, (time.perf_counter() - began) * 1000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            seconds = batch[fallback] if fallback else [None] * len(batch)
            rows = [score_row(scorer, a, b) for a, b in zip(batch[prompt], seconds)]
            scored = pd.DataFrame(rows, columns=[f.name for f in RESULT_FIELDS], index=batch.index)
            scored["label"] = scored["label"].astype("Int32")
            yield pd.concat([batch, scored], axis=1)

    return prompts.mapInPandas(run, schema)
