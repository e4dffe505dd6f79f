"""Models are injected: a plain function of a list of texts becomes a vectorised column function."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """The default embedder: signed feature hashing of words, scaled to length 1; deterministic."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, text in enumerate(texts):
            for w in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)

    return embed


def embed_column(text: Column, embed: Callable[[list[str]], np.ndarray] | None = None) -> Column:
    """Vectors of texts; where a batch fails each text is tried alone, and one that fails gets null."""
    model = embed or hashing_embedder()

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.tolist()
            try:
                yield pd.Series(list(model(texts)))
            except Exception:  # noqa: BLE001
                out = []
                for t in texts:
                    try:
                        out.append(model([t])[0])
                    except Exception:  # noqa: BLE001
                        out.append(None)
                yield pd.Series(out)

    return run(text)


def score_column(a: Column, b: Column, score: Callable[[list[str], list[str]], list[float]]) -> Column:
    """Logits of pairs of texts by an injected cross-encoder."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(score(x.tolist(), y.tolist()), dtype="float64")

    return run(a, b)
