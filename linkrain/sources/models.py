"""Weights of networks: .npz files, downloads with a cache, routing by name. Nothing is unpickled."""

from __future__ import annotations

import hashlib
import urllib.request
from pathlib import Path

import numpy as np

from linkrain.operators.models import Layers

CACHE = Path.home() / ".linkrain" / "models"


def save(layers: Layers, path: str) -> None:
    arrays = {f"{i:03d}_{kind}_{j}": a for i, (kind, parts) in enumerate(layers) for j, a in enumerate(parts or (np.zeros(0),))}
    np.savez(path, **arrays)


def load(path: str) -> Layers:
    found: dict[tuple[int, str], list[np.ndarray]] = {}
    with np.load(path, allow_pickle=False) as f:
        for name in sorted(f.files):
            i, kind, _ = name.split("_")
            found.setdefault((int(i), kind), []).append(f[name])
    return [(kind, tuple(a for a in parts if a.size)) for (_, kind), parts in sorted(found.items())]


def cached(url: str, folder: Path = CACHE, force: bool = False) -> Path:
    """The file of a URL, downloaded if it is not in the cache or force is set."""
    to = folder / f"{hashlib.md5(url.encode()).hexdigest()}{Path(url).suffix}"
    if force or not to.exists():
        folder.mkdir(parents=True, exist_ok=True)
        urllib.request.urlretrieve(url, to)
    return to


def list_cached(folder: Path = CACHE, suffix: str = ".npz") -> list[str]:
    return sorted(p.name for p in folder.glob(f"*{suffix}")) if folder.exists() else []


def clear_cache(folder: Path = CACHE) -> int:
    """Removes the cache's own files and says how many."""
    files = [p for p in folder.glob("*") if p.is_file()] if folder.exists() else []
    for p in files:
        p.unlink()
    return len(files)


def resolve(name: str, folder: Path = CACHE) -> Path:
    """A URL is downloaded, .npz or a path with a slash is local; other suffixes and bare names raise."""
    if name.startswith(("http://", "https://")):
        return cached(name, folder)
    if name.endswith((".pth", ".pt", ".pt2", ".pkl", ".h5")):
        raise ValueError(f"{name}: weights are read from .npz files")
    if name.endswith(".npz") or "/" in name:
        return Path(name)
    raise ValueError(f"{name} is neither a URL nor a file of weights")
