"""Serve the line protocol on a Unix socket, or on standard input and output."""

from __future__ import annotations

import argparse
import logging
import os
import socketserver
import sys
from pathlib import Path

from tidemark.config import load_config
from tidemark.engine import Engine
from tidemark.logs import configure_logging
from tidemark.models import validate_model
from tidemark.rpc import Dispatcher
from tidemark.session import get_spark

log = logging.getLogger(__name__)


def _serve_socket(path: Path, dispatcher: Dispatcher) -> None:
    class Connection(socketserver.StreamRequestHandler):
        def handle(self) -> None:
            event = "rpc_client_connected"
            log.info(event, extra={"event": event, "client": str(self.client_address)})
            dispatcher.serve(self.rfile, self.wfile)

    path.parent.mkdir(parents=True, exist_ok=True)
    path.unlink(missing_ok=True)
    with socketserver.UnixStreamServer(str(path), Connection) as server:
        os.chmod(path, 0o600)
        log.info("daemon_started", extra={"event": "daemon_started"})
        try:
            server.serve_forever()
        except KeyboardInterrupt:
            log.info("daemon_stopped", extra={"event": "daemon_stopped"})
        finally:
            path.unlink(missing_ok=True)


def main(argv: list[str] | None = None, spark=None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark-daemon")
    parser.add_argument("--config", type=Path)
    parser.add_argument("--stdio", action="store_true", help="no socket: stdin to stdout")
    args = parser.parse_args(argv)
    config = load_config(args.config)
    configure_logging(config.paths.log_path)
    if config.model.preload_on_start:
        ok, detail = validate_model(config, offline_only=False)
        if not ok:
            log.error("model_preload_failed: %s", detail, extra={"event": "model_preload_failed"})
            return 2
        log.info("model_preloaded", extra={"event": "model_preloaded"})
    engine = Engine(spark or get_spark(config.app_name), config)
    engine.initialize()
    dispatcher = Dispatcher(engine)
    if args.stdio:
        dispatcher.serve(sys.stdin.buffer, sys.stdout.buffer)
    else:
        _serve_socket(Path(config.paths.socket_path), dispatcher)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
