"""The boundary to models: a typed contract over batches (EXT4-6, EXT12). Which model runs is the caller's
affair; the engine deals prompts to tasks, loads a model once in each worker, applies hooks, and gets tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Hook = Callable[[int, np.ndarray], np.ndarray]


class Model(Protocol):
    """EXT5: ``forward`` returns the logits of the answers, and hidden states (layers, tokens, width) after
    each layer's hook has had them."""

    def forward(self, prompt: str, hook: Hook | None = None) -> tuple[np.ndarray, np.ndarray]: ...


def ablated(layers: set[int], part: slice) -> Hook:
    """EXT6: zeros in a part of the hidden state (a head's width) of some layers."""

    def hook(layer: int, hidden: np.ndarray) -> np.ndarray:
        if layer in layers:
            hidden = hidden.copy()
            hidden[..., part] = 0
        return hidden

    return hook


def patched(source: np.ndarray, layers: set[int]) -> Hook:
    """EXT6: the last token's state from another run."""

    def hook(layer: int, hidden: np.ndarray) -> np.ndarray:
        if layer in layers:
            hidden = hidden.copy()
            hidden[-1] = source[layer, -1]
        return hidden

    return hook


OUT = "layer int, token int, vec array<double>, logits array<double>"


def activations(df: DataFrame, key: str, prompt: str, load: Callable[[], Model], hook: Hook | None = None, last_token: bool = True) -> DataFrame:
    """EXT4 / EXT5 / EXT12: (key, layer, token, vec, logits) for every prompt: of the last token, or of all.
    ``load`` runs once in each task; a null prompt gives no row. Resume by
    :func:`pairloom.streaming.resume.resume` on the key."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or load()
            keys, rows = [], []
            for k, text in zip(batch.column(key).to_pylist(), batch.column(prompt).to_pylist(), strict=True):
                if text is None:
                    continue
                logits, hidden = model.forward(text, hook)
                tokens = [hidden.shape[1] - 1] if last_token else range(hidden.shape[1])
                for layer in range(hidden.shape[0]):
                    for token in tokens:
                        keys.append(k)
                        rows.append((layer, token, hidden[layer, token].tolist(), logits.tolist()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(key).type), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], [key, "layer", "token", "vec", "logits"])

    return df.select(key, prompt).mapInArrow(run, f"`{key}` {kind}, {OUT}")


class LengthModel:
    """A stand-in whose numbers are plain sums, for tests and dry runs: tokens are words, the embedding of a
    word is (its length, 1), each layer adds the state of the word before; the logits are multiples of the
    last token's state."""

    layers = 3

    def forward(self, prompt: str, hook: Hook | None = None) -> tuple[np.ndarray, np.ndarray]:
        words = prompt.split() or [""]
        state = np.array([[len(w), 1.0] for w in words])
        out = []
        for layer in range(self.layers):
            if layer:
                state = state + np.vstack([np.zeros(2), state[:-1]])
            state = hook(layer, state) if hook else state
            out.append(state)
        return np.array([state[-1, 0] * k for k in range(1, 5)]), np.stack(out)
