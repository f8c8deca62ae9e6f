"""Loaders of saved models by type id."""

from __future__ import annotations

from collections.abc import Callable

from lathe.errors import RegistryError
from lathe.sources.bundle import validate_bundle

_LOADERS: dict[str, Callable] = {}


def register(type_id: str, loader: Callable) -> None:
    """`loader(manifest, toc, blobs)` makes a model; the last registration wins."""
    if not isinstance(type_id, str) or "@" not in type_id:
        raise RegistryError(f"a type id is like name@version, not {type_id!r}")
    if not callable(loader):
        raise RegistryError(f"the loader of {type_id} isn't callable")
    _LOADERS[type_id] = loader


def registered() -> dict[str, Callable]:
    return dict(_LOADERS)


def load(raw: bytes):
    manifest, toc, blobs = validate_bundle(raw)
    kind = manifest.get("typeId")
    if kind not in _LOADERS:
        raise RegistryError(f"no loader for {kind!r}; there are {', '.join(sorted(_LOADERS)) or 'none'}")
    return _LOADERS[kind](manifest, toc, blobs)
