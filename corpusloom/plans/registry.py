"""Prepared indexes per namespace, kept with the executors between query batches."""

from __future__ import annotations

from collections.abc import Iterable
from threading import Lock

from pyspark.sql import functions as F

from corpusloom.config import Settings, get_settings
from corpusloom.operators.bm25 import Bm25Index
from corpusloom.sources.chunk_store import ChunkStore


class IndexRegistry:
    """Lazy index handles over a store: build on first use, rebuild on demand."""

    def __init__(self, store: ChunkStore) -> None:
        self._store = store
        self._indexes: dict[tuple[str, ...], Bm25Index] = {}
        self._lock = Lock()

    def get(self, namespaces: Iterable[str]) -> Bm25Index:
        """One index over a set of namespaces; statistics stay separate inside it."""
        key = tuple(sorted(set(namespaces)))
        with self._lock:
            if key not in self._indexes:
                self._indexes[key] = Bm25Index.build(self._store.texts(*key)).persist()
            return self._indexes[key]

    def prime(self, namespaces: Iterable[str]) -> None:
        index = self.get(namespaces)
        index.means.count()
        index.tokens.count()

    def invalidate(self, namespace: str) -> int:
        """Drop every index that covers the namespace; returns its current number of chunks."""
        with self._lock:
            stale = [key for key in self._indexes if namespace in key]
            for key in stale:
                self._indexes.pop(key).unpersist()
        return self.get([namespace]).size(namespace)

    def clear(self) -> None:
        with self._lock:
            for index in self._indexes.values():
                index.unpersist()
            self._indexes.clear()


def health(settings: Settings | None = None) -> dict:
    from corpusloom import __version__

    settings = settings or get_settings()
    return {
        "status": "ok",
        "version": __version__,
        "mock_answers": settings.use_mock_answers,
        "mock_embeddings": settings.use_mock_embeddings,
        "reranker_type": settings.reranker_type,
        "expose_retrieval_debug": settings.expose_retrieval_debug,
    }


def reload_indexes(
    registry: IndexRegistry, namespace: str | None = None, settings: Settings | None = None
) -> dict:
    """Rebuild one namespace or all default ones; with mock embeddings there is nothing to do."""
    settings = settings or get_settings()
    if settings.use_mock_embeddings:
        return {"reloaded": [], "bm25_chunks": {}}
    targets = [namespace] if namespace is not None else list(settings.default_namespaces)
    return {"reloaded": targets, "bm25_chunks": {ns: registry.invalidate(ns) for ns in targets}}


def namespace_chunk_counts(store: ChunkStore):
    """(namespace, chunks) of the store."""
    return store.read().groupBy("namespace").agg(F.count("*").alias("chunks"))
