"""Immutable versions of a stored index and the pointer to the current one.

A version is a short JSON file that names the layers of every table. Nothing a version names is
ever changed: a change writes new layers first and then publishes one new version file. Files are
numbered and never overwritten, so a reader sees the old version or the new one, a driver that dies
in between leaves the old one, and of two writers that started from the same version one is refused.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

from tidemark.session import file_system

_DIGITS = 12


class ConcurrentChangeError(RuntimeError):
    pass


@dataclass(frozen=True)
class Version:
    """``layers[table]``: names of the table's layers, oldest first."""

    number: int = 0
    layers: dict[str, tuple[str, ...]] = field(default_factory=dict)
    settings: dict = field(default_factory=dict)

    def of(self, table: str) -> tuple[str, ...]:
        return self.layers.get(table, ())

    def names(self) -> set[str]:
        return {name for names in self.layers.values() for name in names}


def new_layer(sequence: int) -> str:
    """A folder name that sorts by ``sequence`` and is never used twice."""
    return f"{sequence:0{_DIGITS}d}-{uuid.uuid4().hex[:12]}"


def sequence_of(layer: str) -> int:
    return int(layer[:_DIGITS])


class Pointer:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _numbers(self) -> list[int]:
        fs, target = file_system(self.spark, self.folder)
        if not fs.exists(target):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(target)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _path(self, number: int) -> str:
        return f"{self.folder}/{number:0{_DIGITS}d}.json"

    def _read(self, number: int) -> Version:
        fs, target = file_system(self.spark, self._path(number))
        stream = fs.open(target)
        try:
            data = json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        finally:
            stream.close()
        layers = {t: tuple(names) for t, names in data["layers"].items()}
        return Version(number, layers, data["settings"])

    def current(self) -> Version | None:
        numbers = self._numbers()
        return self._read(numbers[-1]) if numbers else None

    def publish(self, version: Version) -> Version:
        """Make ``version`` the successor of the version it was made from."""
        nxt = replace(version, number=version.number + 1)
        fs, target = file_system(self.spark, self._path(nxt.number))
        if version.number != max(self._numbers(), default=0):
            raise ConcurrentChangeError(f"Version {nxt.number} of {self.folder} was published by another writer.")
        body = json.dumps({"layers": {t: list(n) for t, n in nxt.layers.items()}, "settings": nxt.settings})
        # Written aside and renamed: a half-written file never has a version's name.
        _, aside = file_system(self.spark, f"{self.folder}/.{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        try:
            stream.write(bytearray(body.encode("utf-8")))
        finally:
            stream.close()
        if fs.exists(target) or not fs.rename(aside, target):
            fs.delete(aside, False)
            raise ConcurrentChangeError(f"Version {nxt.number} of {self.folder} was published by another writer.")
        return nxt

    def forget(self, keep: int) -> set[str]:
        """Drop all but the ``keep`` newest versions; the layers only dropped ones named."""
        numbers = self._numbers()
        old, kept = numbers[:-keep], numbers[-keep:]
        gone = {name for n in old for name in self._read(n).names()}
        gone -= {name for n in kept for name in self._read(n).names()}
        for number in old:
            fs, target = file_system(self.spark, self._path(number))
            fs.delete(target, False)
        return gone
