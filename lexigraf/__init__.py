"""Retrieval over versioned code and text on Spark."""

from importlib import import_module

#: What the package offers by name; a module is imported when its name is first asked for, so that workers stay light.
_EXPORTS = {
    "ChunkFrame": "sources.frames",
    "GraphFrame": "sources.frames",
    "IndexStats": "sources.store",
    "Pipeline": "pipeline",
    "Settings": "config",
    "VersionFrame": "sources.frames",
    "VersionedStore": "sources.store",
}
__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    if name not in _EXPORTS:
        raise AttributeError(name)
    return getattr(import_module(f".{_EXPORTS[name]}", __name__), name)
