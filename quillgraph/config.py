"""Project configuration: defaults, merging, loading and saving."""

from __future__ import annotations

import dataclasses
import json
import os
import shutil
from dataclasses import dataclass, field

from quillgraph.errors import ConfigNotFoundError

FOLDER, FILE = ".quillgraph", "config.json"


@dataclass(frozen=True)
class EmbeddingConfig:
    model: str = "multilingual-e5-large"
    dimensions: int = 1024
    batch_size: int = 32


@dataclass(frozen=True)
class SearchConfig:
    alpha: float = 0.7
    default_limit: int = 5
    max_depth: int = 2


@dataclass(frozen=True)
class Config:
    docs_path: str = "docs"
    include: tuple[str, ...] = ("**/*.md",)
    exclude: tuple[str, ...] = ("**/node_modules/**", "**/.git/**")
    embedding: EmbeddingConfig = field(default_factory=EmbeddingConfig)
    search: SearchConfig = field(default_factory=SearchConfig)


def merged(values: dict | None) -> Config:
    """Defaults, replaced key by key where a value is given; unknown keys and nulls are ignored."""

    def over(base, given: dict | None):
        names = {f.name for f in dataclasses.fields(base)}
        changes = {}
        for k, v in (given or {}).items():
            if k not in names or v is None:
                continue
            own = getattr(base, k)
            changes[k] = over(own, v) if dataclasses.is_dataclass(own) else tuple(v) if isinstance(own, tuple) else v
        return dataclasses.replace(base, **changes)

    return over(Config(), values)


def config_path(root: str) -> str:
    return os.path.join(root, FOLDER, FILE)


def exists(root: str) -> bool:
    return os.path.exists(config_path(root))


def load(root: str) -> Config:
    if not exists(root):
        raise ConfigNotFoundError(f"no configuration at {config_path(root)}")
    with open(config_path(root), encoding="utf-8") as f:
        return merged(json.load(f))


def save(root: str, config: Config) -> None:
    os.makedirs(os.path.dirname(config_path(root)), exist_ok=True)
    with open(config_path(root), "w", encoding="utf-8") as f:
        json.dump(dataclasses.asdict(config), f, indent=2)


def clean(root: str) -> bool:
    """Removes the project folder; tells whether there was one."""
    folder = os.path.join(root, FOLDER)
    if not os.path.isdir(folder):
        return False
    shutil.rmtree(folder)
    return True
