"""Is the configured model usable? Checked on the driver."""

from __future__ import annotations

from pathlib import Path

from tidemark.config import Config
from tidemark.operators import embed as E


def validate_model(config: Config, offline_only: bool) -> tuple[bool, str]:
    """``(ok, detail)``; never raises.

    Nothing is downloaded: a model is a local folder, or must already be in the
    cache folder.
    """
    model = config.model
    if model.backend == "hashing":
        return True, "built-in model, nothing to resolve"
    try:
        if model.backend == "sentence_transformers":
            E.load_sentence_transformer(model.name, model.cache_dir, config.runtime.max_batch_size)
        elif model.backend == "mlx":
            E.load_mlx(model.name, config.runtime.max_batch_size)
        elif not Path(model.name).exists():
            return True, "backend registered by the caller"
    except Exception as exc:
        return False, str(exc)
    source = "local cache" if offline_only else "local cache and/or remote"
    return True, f"model resolved {'from ' if offline_only else '('}{source}{'' if offline_only else ')'}"
