"""Command line: results to stdout, messages to stderr."""

from __future__ import annotations

import argparse
import json
import sys
from functools import cached_property
from pathlib import Path

import tidemark
from tidemark import config as CF
from tidemark.engine import Engine
from tidemark.functions.display import human_size_of
from tidemark.logs import configure_logging
from tidemark.models import validate_model
from tidemark.operators.search import DEFAULT_TOP_K, EmptyIndexError
from tidemark.session import get_spark


def _say(text: str) -> None:
    print(text, file=sys.stderr)


def _table(rows) -> None:
    for row in rows:
        _say("  ".join(str(cell) for cell in row))


def _band(score: float) -> str:
    return "green" if score > 0.8 else "yellow" if score > 0.5 else "red"


class Cli:
    """One invocation. ``spark`` and ``embedder`` can be handed in."""

    def __init__(self, args: argparse.Namespace, spark=None, embedder=None):
        self.args = args
        self._spark = spark
        self._embedder = embedder

    @cached_property
    def config(self) -> CF.Config:
        config = CF.load_config(self.args.config)
        configure_logging(config.paths.log_path)
        return config

    @cached_property
    def engine(self) -> Engine:
        spark = self._spark or get_spark(self.config.app_name)
        return Engine(spark, self.config, self._embedder)

    def show(self, payload, text) -> int:
        """Print JSON if asked for, else the text form."""
        if getattr(self.args, "json", False):
            print(json.dumps(payload, indent=2 if self.args.command == "search" else None))
        else:
            text()
        return 0

    def ingest(self) -> int:
        report = [r.asDict(recursive=True) for r in self.engine.ingest(self.args.inputs).collect()]
        rows = (
            (Path(r["source_path"]).name, r["source_kind"], r["document_id"][:16] + "...")
            for r in report
        )
        return self.show(report, lambda: _table([("File", "Kind", "Document ID"), *rows]))

    def search(self) -> int:
        try:
            found = self.engine.search(self.args.query, self.args.limit).collect()
        except EmptyIndexError as exc:
            _say(str(exc))
            return 1
        fields = ("score", "document_id", "source_path", "chunk_index", "chunk_text")
        hits = [{f: row[f] for f in fields} for row in found]

        def text() -> None:
            if not hits:
                _say("No results found.")
            for h in hits:
                name = Path(h["source_path"]).name
                _say(f"[{_band(h['score'])}] {h['score']:.4f}  {name}\n{h['chunk_text']}\n")

        return self.show(hits, text)

    def status(self) -> int:
        c = self.config
        self.engine.tables.migrate()
        found = self.engine.status()
        payload = {
            "app_name": c.app_name,
            "model_name": c.model.name,
            "model_backend": c.model.backend,
            "model_cache_dir": c.model.cache_dir,
            "data_dir": c.paths.data_dir,
            "sqlite_path": c.paths.metadata_path,
            "qdrant_path": c.paths.vector_path,
            "socket_path": c.paths.socket_path,
            "log_path": c.paths.log_path,
            "max_batch_size": c.runtime.max_batch_size,
            "max_concurrency": c.runtime.max_concurrency,
            "query_cache_size": c.runtime.query_cache_size,
            "preload_on_start": c.model.preload_on_start,
            "schema_version": found["schema_version"],
            "qdrant_collection": found["collection_name"],
            "qdrant_points_count": found["points_count"],
            "documents_count": found["documents_count"],
        }
        return self.show(payload, lambda: _table(payload.items()))

    def storage(self) -> int:
        usage = self.engine.storage_usage()
        rows = [
            ("Metadata", human_size_of(usage["sqlite_bytes"]), usage["sqlite_path"]),
            ("Vectors", human_size_of(usage["qdrant_bytes"]), usage["qdrant_path"]),
            ("Total", human_size_of(usage["total_bytes"])),
        ]
        return self.show(usage, lambda: _table(rows))

    def reset(self) -> int:
        stores = self.engine.stores()
        if not stores:
            nothing = "Nothing to reset: no stores found."
            return self.show({"status": "nothing_to_reset"}, lambda: _say(nothing))
        if not self.args.force:
            _say("This will permanently delete:")
            _table(stores.items())
            _say("Are you sure? [y/N]")
            if sys.stdin.readline().strip().lower() not in ("y", "yes"):
                _say("Aborted.")
                return 1
        deleted = self.engine.reset()
        payload = {"status": "reset_complete", "deleted": deleted}
        return self.show(payload, lambda: _say("Reset complete. Deleted: " + ", ".join(deleted)))

    def models(self) -> int:
        model = self.config.model
        if self.args.action == "show":
            _table([("model." + k, v) for k, v in vars(model).items()])
            if model.backend == "mlx":
                _table([("family", f) for f in CF.MLX_ARCHITECTURES])
            _table([("known model", m) for m in CF.KNOWN_MODELS.get(model.backend, ())])
            return 0
        checked: dict = {"model_name": model.name, "cache_dir": model.cache_dir}
        offline = self.args.action == "validate" and self.args.offline_only
        if self.args.action == "validate":
            checked["offline_only"] = offline
        ok, detail = validate_model(self.config, offline)
        checked |= {"ok": ok, "detail": detail}
        if self.args.action == "validate" or self.args.json:
            print(json.dumps(checked))
        else:
            _table(checked.items())
        return 0 if ok else 2

    def version(self) -> int:
        ver = tidemark.__version__
        return self.show({"version": ver}, lambda: _say(f"tidemark v{ver}"))

    def reindex(self) -> int:
        """Merge the layers of the stored index and delete what no version names any more."""
        self.engine.tables.compact(everything=True)
        deleted = self.engine.tables.vacuum()
        _say(f"Index compacted, {deleted} old layers deleted.")
        return 0

    def doctor(self) -> int:
        """Whether every layer that the current version names is there."""
        missing = self.engine.tables.missing_layers()
        _say("\n".join(f"missing: {name}" for name in missing) or "The index is complete.")
        return 2 if missing else 0


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("--config", type=Path, help="path to config.toml")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, with_json: bool = True, parent=commands):
        sub = parent.add_parser(name, help=text)
        if with_json:
            sub.add_argument("--json", action="store_true", help="emit JSON")
        return sub

    command("ingest", "extract, chunk, embed and index files").add_argument("inputs", nargs="+")
    search = command("search", "semantic similarity search")
    search.add_argument("query")
    search.add_argument("--limit", "-n", type=int, default=DEFAULT_TOP_K)
    command("status", "configuration and index status")
    command("storage", "disk usage")
    command("reset", "delete all indexed data").add_argument("--force", action="store_true")
    command("version", "show the version")
    command("reindex", "compact the stored index", with_json=False)
    command("doctor", "check the stored index", with_json=False)
    actions = command("models", "embedding models", with_json=False).add_subparsers(
        dest="action", required=True
    )
    command("show", "configured model", with_json=False, parent=actions)
    validate = command("validate", "check the model", with_json=False, parent=actions)
    validate.add_argument("--offline-only", action="store_true")
    command("bootstrap", "resolve the model for offline use", parent=actions)
    return parser


def main(argv: list[str] | None = None, spark=None, embedder=None) -> int:
    args = build_parser().parse_args(argv)
    return getattr(Cli(args, spark, embedder), args.command)()


if __name__ == "__main__":
    raise SystemExit(main())
