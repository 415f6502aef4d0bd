"""Errors beyond ValueError, which stands for bad input."""


class CollectionNotFoundError(KeyError):
    def __init__(self, name: str):
        super().__init__(f"collection not found: {name}")


class CollectionExistsError(ValueError):
    def __init__(self, name: str):
        super().__init__(f"collection already exists: {name}")


class LogCorruptedError(RuntimeError):
    """A change-log segment that a manifest lists is missing or differs from what was written."""


class SnapshotCorruptedError(RuntimeError):
    """Manifests exist and none of them is valid."""
