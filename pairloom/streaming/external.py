"""The boundary to models and remote services: any callable over batches, with retries (EXT1-3)."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

FENCE = re.compile(r"^```(?:json)?\s*|\s*```$")


def call_with_retries(call: Callable[[str], str], prompt: str, retries: int = 3, pause: float = 1.0) -> str | None:
    """The parsed answer as JSON text, fences removed; None after the last failure. Pauses double."""
    for attempt in range(retries):
        try:
            return json.dumps(json.loads(FENCE.sub("", call(prompt).strip())))
        except Exception:  # noqa: BLE001  whatever the service raises counts as a failure
            if attempt + 1 < retries:
                time.sleep(pause * 2**attempt)
    return None


def ask(df: DataFrame, key: str, prompt: str, call: Callable[[str], str], retries: int = 3, pause: float = 1.0) -> DataFrame:
    """(key, response): one call per row, in as many at a time as there are tasks."""

    def run(batches):
        for batch in batches:
            answers = [call_with_retries(call, p, retries, pause) if p is not None else None for p in batch.column(prompt).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(answers, pa.string())], [key, "response"])

    return df.select(key, prompt).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, response string")
