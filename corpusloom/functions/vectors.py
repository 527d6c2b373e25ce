"""Vector expressions and embedder strategies."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.config import Settings, get_settings
from corpusloom.functions.text import let

_WORDS_PER_DIGEST = 8


class EncoderModel(Protocol):
    """What an injected sentence encoder has to offer."""

    def encode(self, sentences: list[str], **options) -> np.ndarray: ...


def _digest_word(digest: Column, index: int) -> Column:
    """Little-endian signed 32-bit word ``index`` of a hex digest, scaled to [-1, 1)."""
    at = index * 8 + 1
    big_endian = F.concat(*[F.substring(digest, at + shift, 2) for shift in (6, 4, 2, 0)])
    unsigned = F.conv(big_endian, 16, 10).cast("long")
    signed = F.when(unsigned >= 2**31, unsigned - 2**32).otherwise(unsigned)
    return signed / F.lit(float(2**31))


def mock_embedding(text: Column, dim: int) -> Column:
    """Reproducible stand-in vector: the SHA-256 words of the text, repeated up to ``dim``."""
    words = let(
        F.sha2(text, 256),
        lambda digest: F.array(*[_digest_word(digest, i) for i in range(_WORDS_PER_DIGEST)]),
    )
    repeats = -(-dim // _WORDS_PER_DIGEST)
    filled = F.slice(F.flatten(F.array_repeat(words, repeats)), 1, dim)
    return filled.cast("array<float>")


def model_embedding(
    text: Column, load_model: Callable[[], EncoderModel], batch_size: int = 32
) -> Column:
    """Unit-length vectors from a model that each Python worker loads once."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for texts in batches:
            vectors = model.encode(
                texts.tolist(),
                batch_size=batch_size,
                normalize_embeddings=True,
                show_progress_bar=False,
                convert_to_numpy=True,
            )
            yield pd.Series(list(np.asarray(vectors, dtype=np.float32)), index=texts.index)

    return encode(text)


def embedding_or_error(text: Column, load_model: Callable[[], EncoderModel], batch_size: int = 32) -> Column:
    """(vector, error) of each text: a text that the model fails on costs its own row, not the job.

    A batch that fails is encoded text by text. A model that cannot be loaded fails the task.
    """

    @F.pandas_udf("vector array<float>, error string")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load_model()
        options = {"batch_size": batch_size, "normalize_embeddings": True, "show_progress_bar": False, "convert_to_numpy": True}

        def tried(texts: list[str]) -> list[tuple]:
            try:
                return [(vector, None) for vector in np.asarray(model.encode(texts, **options), dtype=np.float32)]
            except Exception as problem:
                if len(texts) == 1:
                    return [(None, f"{type(problem).__name__}: {problem}")]
                return [row for one in texts for row in tried([one])]

        for texts in batches:
            rows = tried(texts.tolist()) if len(texts) else []
            yield pd.DataFrame(rows, columns=["vector", "error"], index=texts.index)

    return encode(text)


def _model_by_name(settings: Settings) -> Callable[[], EncoderModel]:
    def load() -> EncoderModel:
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(settings.dense_model_name)
        model.max_seq_length = settings.max_seq_length
        return model

    return load


def get_embedder(
    settings: Settings | None = None, load_model: Callable[[], EncoderModel] | None = None
) -> Callable[[Column], Column]:
    """The embedding strategy the settings ask for, as a Column function."""
    settings = settings or get_settings()
    if settings.use_mock_embeddings:
        return lambda text: mock_embedding(text, settings.dense_dim)

    return lambda text: model_embedding(text, load_model or _model_by_name(settings), settings.embed_batch_size)


def get_embedder_or_error(
    settings: Settings | None = None, load_model: Callable[[], EncoderModel] | None = None
) -> Callable[[Column], Column]:
    """The same strategy as (vector, error) of each text; mock vectors never fail."""
    settings = settings or get_settings()
    if settings.use_mock_embeddings:
        return lambda text: F.struct(mock_embedding(text, settings.dense_dim).alias("vector"), F.lit(None).cast("string").alias("error"))
    return lambda text: embedding_or_error(text, load_model or _model_by_name(settings), settings.embed_batch_size)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of one row; use ``dense_search`` for many queries at once."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, term: total + term)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
