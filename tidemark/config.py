"""Configuration file (TOML) with defaults and checks."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from tidemark.operators.embed import backends
from tidemark.sources.files import is_uri, local_path

DEFAULT_CONFIG_PATH = Path.home() / ".tidemark" / "config.toml"

# Model a backend uses when none is named, and its vector size.
DEFAULT_MODELS = {
    "hashing": ("hashing-words", 256),
    "mlx": ("mlx-community/nomicai-modernbert-embed-base-bf16", 768),
    "sentence_transformers": ("BAAI/bge-m3", 1024),
}
DEFAULT_BACKEND = "hashing"

# Shown by "models show".
MLX_ARCHITECTURES = ("XLM-RoBERTa", "BERT", "ModernBERT", "Qwen3", "Qwen3-VL")
KNOWN_MODELS = {
    "hashing": ("hashing-words",),
    "mlx": (
        "mlx-community/nomicai-modernbert-embed-base-bf16",
        "mlx-community/all-MiniLM-L6-v2-4bit",
        "mlx-community/answerdotai-ModernBERT-base-4bit",
        "Qwen/Qwen3-Embedding-0.6B",
        "Qwen/Qwen3-Embedding-4B",
    ),
    "sentence_transformers": ("BAAI/bge-m3",),
}


@dataclass(frozen=True)
class Model:
    name: str
    backend: str
    cache_dir: str
    preload_on_start: bool
    vector_size: int


@dataclass(frozen=True)
class Paths:
    """Local folders or URIs of a shared file system."""

    data_dir: str
    metadata_path: str
    vector_path: str
    socket_path: str
    log_path: str


@dataclass(frozen=True)
class Runtime:
    max_batch_size: int
    max_concurrency: int
    query_cache_size: int
    # Digits of the document hash that name a partition of a new index.
    partition_hex_digits: int


@dataclass(frozen=True)
class Config:
    app_name: str
    model: Model
    paths: Paths
    runtime: Runtime


def expand(path: str | Path) -> str:
    text = local_path(os.path.expandvars(str(path)))
    return text.rstrip("/") if is_uri(text) else str(Path(text).expanduser().resolve())


class _Section:
    """Checked access to one table of the file; unknown keys are ignored."""

    def __init__(self, doc: dict[str, Any], name: str):
        self.name = name
        self.values = doc.get(name, {})
        if not isinstance(self.values, dict):
            raise ValueError(f"[{name}] is not a table of keys.")

    def _fail(self, key: str, what: str):
        raise ValueError(f"{self.name}.{key} must be {what}.")

    def text(self, key: str, default: str) -> str:
        value = self.values.get(key, default)
        if not isinstance(value, str) or not value.strip():
            self._fail(key, "a non-empty string")
        return value.strip()

    def positive(self, key: str, default: int) -> int:
        value = self.values.get(key, default)
        if not isinstance(value, int) or value <= 0:
            self._fail(key, "a positive integer")
        return value

    def flag(self, key: str, default: bool) -> bool:
        value = self.values.get(key, default)
        if not isinstance(value, bool):
            self._fail(key, "a boolean")
        return value

    def path(self, key: str, default: str) -> str:
        return expand(self.values.get(key, default))


def parse_config(doc: dict[str, Any]) -> Config:
    app, model, paths, runtime = (
        _Section(doc, name) for name in ("app", "model", "paths", "runtime")
    )
    backend = model.values.get("backend", DEFAULT_BACKEND)
    if backend not in backends():
        raise ValueError(f"model.backend '{backend}' is unknown; known are {', '.join(backends())}.")
    model_name, vector_size = DEFAULT_MODELS.get(backend, (backend, 256))
    data_dir = paths.path("data_dir", str(DEFAULT_CONFIG_PATH.parent))

    def inside(key: str, name: str) -> str:
        path = paths.path(key, f"{data_dir}/{name}")
        if not f"{path}/".startswith(f"{data_dir}/"):
            raise ValueError(f"paths.{key} lies outside paths.data_dir.")
        return path

    return Config(
        app_name=app.text("name", "tidemark"),
        model=Model(
            name=model.text("name", model_name),
            backend=backend,
            cache_dir=model.path("cache_dir", f"{data_dir}/models"),
            preload_on_start=model.flag("preload_on_start", False),
            vector_size=model.positive("vector_size", vector_size),
        ),
        paths=Paths(
            data_dir=data_dir,
            # The key names are those of existing configuration files.
            metadata_path=inside("sqlite_path", "metadata.db"),
            vector_path=inside("qdrant_path", "qdrant"),
            socket_path=paths.path("socket_path", f"{data_dir}/daemon.sock"),
            log_path=inside("log_path", "tidemark.log"),
        ),
        runtime=Runtime(
            max_batch_size=runtime.positive("max_batch_size", 64),
            max_concurrency=runtime.positive("max_concurrency", 4),
            query_cache_size=runtime.positive("query_cache_size", 2048),
            # 16 partitions in a local folder, 4096 on a shared file system.
            partition_hex_digits=runtime.positive(
                "partition_hex_digits", 3 if is_uri(data_dir) else 1
            ),
        ),
    )


def render_config(config: Config) -> str:
    m, p, r = config.model, config.paths, config.runtime
    sections = {
        "app": {"name": config.app_name},
        "model": {
            "name": m.name,
            "backend": m.backend,
            "cache_dir": m.cache_dir,
            "preload_on_start": m.preload_on_start,
            "vector_size": m.vector_size,
        },
        "paths": {
            "data_dir": p.data_dir,
            "sqlite_path": p.metadata_path,
            "qdrant_path": p.vector_path,
            "socket_path": p.socket_path,
            "log_path": p.log_path,
        },
        "runtime": {
            "max_batch_size": r.max_batch_size,
            "max_concurrency": r.max_concurrency,
            "query_cache_size": r.query_cache_size,
            "partition_hex_digits": r.partition_hex_digits,
        },
    }

    def literal(value) -> str:
        return str(value).lower() if isinstance(value, (bool, int)) else f'"{value}"'

    return "\n".join(
        f"[{name}]\n" + "".join(f"{k} = {literal(v)}\n" for k, v in values.items())
        for name, values in sections.items()
    )


def load_config(path: str | Path | None = None) -> Config:
    """Read the file, writing one with the defaults first if there is none."""
    target = Path(expand(path or DEFAULT_CONFIG_PATH))
    if not target.exists():
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(render_config(parse_config({})), encoding="utf-8")
    config = parse_config(tomllib.loads(target.read_text(encoding="utf-8")))
    for folder in (config.paths.data_dir, config.model.cache_dir, config.paths.vector_path):
        if not is_uri(folder):
            Path(folder).mkdir(parents=True, exist_ok=True)
    return config
