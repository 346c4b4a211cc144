"""Answers that cost: each is kept in the shared folder as soon as it is there, so that a task that runs again does not ask again."""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyarrow import fs


@dataclass(frozen=True)
class Ledger:
    """A folder of answers by key; ``root`` is a path that the driver and all executors share (local, or of a file system that Arrow reads)."""

    root: str

    def _at(self, key: str) -> tuple[fs.FileSystem, str]:
        system, top = fs.FileSystem.from_uri(re.sub("^file:/+", "/", self.root))
        return system, f"{top}/{key[:2]}/{key}.json"

    def get(self, key: str) -> str | None:
        system, path = self._at(key)
        if system.get_file_info(path).type != fs.FileType.File:
            return None
        with system.open_input_stream(path) as f:
            return json.loads(f.read())["answer"]

    def put(self, key: str, answer: str) -> None:
        """Written whole under a name of its own first: two tasks may answer one cell, a reader finds one answer or none."""
        system, path = self._at(key)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        new = f"{path}.{uuid.uuid4().hex}"
        with system.open_output_stream(new) as f:
            f.write(json.dumps({"answer": answer}).encode())
        system.move(new, path)


def key_of(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, default=str).encode()).hexdigest()


def answered(ledger: Ledger, key: str, ask: Callable[[], str], waits: tuple[float, ...]) -> tuple[str | None, str | None]:
    """The answer, from the ledger or asked for (again after each of the ``waits``), and the last error where there is none."""
    if (known := ledger.get(key)) is not None:
        return known, None
    error = None
    for wait in (*waits, None):
        try:
            answer = ask()
            ledger.put(key, answer)
            return answer, None
        except Exception as e:  # noqa: BLE001 - whatever a provider raises concerns this cell only
            error = f"{type(e).__name__}: {e}"
        if wait is not None:
            time.sleep(wait)
    return None, error
