import json
import subprocess
import sys
from pathlib import Path

import pytest

from tidemark.config import load_config, parse_config, render_config


def test_defaults_are_written_and_read_back(tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path))
    path = tmp_path / "sub" / "config.toml"
    path.parent.mkdir()
    path.write_text(render_config(parse_config({"paths": {"data_dir": str(tmp_path / "d")}})))
    config = load_config(path)
    assert config.model.backend == "hashing" and config.runtime.max_batch_size == 64
    assert config.paths.vector_path == str(tmp_path / "d" / "qdrant")
    assert (tmp_path / "d" / "qdrant").is_dir()
    assert load_config(path) == config


@pytest.mark.parametrize(
    "doc, message",
    [
        ({"model": {"backend": "nope"}}, "model.backend 'nope' is unknown"),
        ({"runtime": {"max_batch_size": 0}}, "runtime.max_batch_size must be a positive integer"),
        ({"runtime": {"max_concurrency": "4"}}, "runtime.max_concurrency must be a positive integer"),
        ({"app": {"name": "  "}}, "app.name must be a non-empty string"),
        ({"model": {"preload_on_start": 1}}, "model.preload_on_start must be a boolean"),
        ({"paths": 3}, r"\[paths\] is not a table"),
        ({"paths": {"data_dir": "/x", "sqlite_path": "/y/m.db"}}, "paths.sqlite_path lies outside"),
        ({"paths": {"data_dir": "/x", "log_path": "/xy/l"}}, "paths.log_path lies outside"),
    ],
)
def test_rejected(doc, message):
    with pytest.raises(ValueError, match=message):
        parse_config(doc)


def test_accepted():
    config = parse_config(
        {
            "app": {"name": " mine ", "other": 1},
            "paths": {"data_dir": "s3a://bucket/index/", "socket_path": "/tmp/s"},
            "runtime": {"max_batch_size": True},
            "model": {"backend": "sentence_transformers"},
        }
    )
    assert config.app_name == "mine" and config.runtime.max_batch_size is True
    assert config.paths.vector_path == "s3a://bucket/index/qdrant"
    assert config.model.name == "BAAI/bge-m3" and config.model.vector_size == 1024


def test_log_lines(tmp_path):
    code = (
        "import logging, sys; from tidemark.logs import configure_logging; configure_logging(sys.argv[1]);"
        "logging.getLogger('n').info('m %s', 1, extra={'event': 'e', 'source_path': 'dropped'})"
    )
    path = tmp_path / "sub" / "x.log"
    subprocess.run([sys.executable, "-c", code, str(path)], check=True, cwd=Path(__file__).parent.parent)
    line = json.loads(path.read_text())
    assert line.pop("ts")
    assert line == {"level": "INFO", "logger": "n", "message": "m 1", "event": "e"}
