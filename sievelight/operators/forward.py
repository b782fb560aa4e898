"""Scores and attributions of a trained fusion network, from its exported weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Modalities and their columns; what stands for an absent modality before the softmax.
SLICES = ((0, 8), (8, 32), (32, 34), (34, 42))
ABSENT = float(np.finfo(np.float32).min)


def gelu(x: np.ndarray) -> np.ndarray:
    """GELU in its tanh form."""
    return 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3)))


def group_norm(x: np.ndarray, groups: int, weight: np.ndarray, bias: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    """Rows normalised within groups of columns, with the variance over all values of a group."""
    parts = x.reshape(len(x), groups, -1)
    centred = parts - parts.mean(axis=2, keepdims=True)
    scaled = centred / np.sqrt((centred**2).mean(axis=2, keepdims=True) + eps)
    return scaled.reshape(x.shape) * weight + bias


def masked_softmax(logits: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Softmax over what is there; all alike where nothing is."""
    held = np.where(there.any(axis=1, keepdims=True), np.where(there, logits, ABSENT), 0.0)
    e = np.exp(held - held.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _linear(x: np.ndarray, layer: dict) -> np.ndarray:
    return x @ np.asarray(layer["weight"], np.float64).T + np.asarray(layer["bias"], np.float64)


def forward(x: np.ndarray, available: np.ndarray, weights: dict) -> tuple[np.ndarray, np.ndarray]:
    """Score and attribution (the gate's shares of the modalities) of each row."""
    embedded = []
    for (a, b), encoder in zip(weights.get("modality_slices", SLICES), weights["encoders"], strict=True):
        norm = encoder["groupnorm"]
        hidden = group_norm(_linear(x[:, a:b], encoder["linear0"]), norm["num_groups"], np.asarray(norm["weight"]), np.asarray(norm["bias"]), norm.get("eps", 1e-5))
        embedded.append(_linear(gelu(hidden), encoder["linear1"]))
    fusion, head = weights["fusion"], weights["head"]
    gate = gelu(_linear(np.hstack([*embedded, available.astype(np.float64)]), fusion["gate_linear0"]))
    gates = masked_softmax(_linear(gate, fusion["gate_linear1"]), available >= 0.5)
    fused = np.einsum("nm,nmd->nd", gates, np.tanh(np.stack(embedded, axis=1)))
    logit = _linear(gelu(_linear(fused, head["linear0"])), head["linear1"])[:, 0]
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-logit)), gates


def with_scores(rows: DataFrame, columns: list[str], flags: list[str], weights: dict) -> DataFrame:
    """Rows with ``score`` and ``attribution`` (one share a modality), batch by batch in tasks.

    The weights (some thousand numbers) are broadcast. Null values count as zero
    and null flags as absent; an empty table gives an empty one.
    """
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    kept = [c for c in rows.columns if c.lower() not in ("score", "attribution")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*(f"`{c}`" for c in kept)).schema)

    def matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
        return np.nan_to_num(np.column_stack([np.asarray(batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)) for c in names]), nan=0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = pa.RecordBatch.from_arrays([c.cast(pa.int8()) if pa.types.is_boolean(c.type) else c for c in batch.columns], names=batch.schema.names)
            score, gates = forward(matrix(flat, columns), matrix(flat, flags), shared.value)
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * gates.shape[1])
            share = pa.ListArray.from_arrays(ends, pa.array(gates.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(score), share], names=[*kept, "score", "attribution"])

    return rows.mapInArrow(run, f"{kinds}, score double, attribution array<double>")
