"""The dictionary by itself, over the same id space as the store at its path."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from tidemark.sources.store import Store


class Dictionary:
    """External strings and their ids. UUIDs are kept in their lower-case hyphenated form."""

    def __init__(self, spark: SparkSession, path: str, map_size: int | None = None):
        self.store = Store(spark, path, map_size=map_size)

    def get_or_assign(self, name: str) -> int:
        return self.store.assign([name])[0]

    def get_or_assign_batch(self, names: list[str]) -> list[int]:
        return self.store.assign(names)

    def lookup(self, name: str) -> int | None:
        return self.store.lookup(name)

    def lookup_batch(self, names: list[str]) -> list[int | None]:
        return self.store.lookup_batch(names)

    def contains(self, name: str) -> bool:
        return self.lookup(name) is not None

    def resolve(self, id: int) -> str | None:
        return self.store.resolve(id)

    def resolve_batch(self, ids: list[int]) -> list[str | None]:
        return self.store.resolve_batch(ids)

    def resolved_pairs(self, ids: list[int]) -> dict[int, str]:
        return {i: n for i, n in zip(ids, self.resolve_batch(ids), strict=True) if n is not None}

    def delete(self, name: str) -> int | None:
        return self.store.delete_name(name)

    def __len__(self) -> int:
        return self.store.dictionary_len()

    def is_empty(self) -> bool:
        return self.store.dictionary().isEmpty()

    # UUID forms

    def get_or_assign_uuid(self, value) -> int:
        return self.get_or_assign(Store._uuid(value))

    def get_or_assign_uuids(self, values: list) -> list[int]:
        return self.get_or_assign_batch([Store._uuid(v) for v in values])

    def lookup_uuid(self, value) -> int | None:
        return self.lookup(Store._uuid(value))

    def lookup_uuids(self, values: list) -> list[int | None]:
        return self.lookup_batch([Store._uuid(v) for v in values])

    def resolve_uuid(self, id: int) -> uuid.UUID | None:
        """None where the id is unknown or its string is no UUID."""
        try:
            return uuid.UUID(self.resolve(id) or "")
        except ValueError:
            return None

    def delete_uuid(self, value) -> int | None:
        return self.delete(Store._uuid(value))

    def close(self) -> None:
        self.store.close()


