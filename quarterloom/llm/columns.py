"""Whole Arrow text columns as bytes: counting and searching over a batch at once, without a Python object per text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column in a row, and where each row starts (one more entry for the end); a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
        texts = texts.cast(pa.string())
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, data = texts.buffers()
    if len(texts) == 0 or data is None or places is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    starts = np.frombuffer(places, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def rows_of(places: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The row each byte place lies in."""
    return np.searchsorted(starts, places, side="right") - 1


def counts(mask: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many marked bytes each row has."""
    return np.bincount(rows_of(np.flatnonzero(mask), starts), minlength=len(starts) - 1).astype(np.int64)
