"""Calls that are made once: answers of a model are put into a table before the rows that need them are emitted.

A call is named by the hash of its model, purpose, prompt and attempt. Once looks its answer up first, so a task that is retried, run
twice or started again after its executor was lost reuses the answers that it had got, and tokens() books each call once. It wraps any
provider of this library: of extraction.extract(), ask_subjects(), evaluation.judge() and vector.embed().

The table is a folder of small JSON files in a file system of pyarrow, which all tasks reach. On a local or mounted disk a call is locked
by a file, so two tasks that ask the same at once make one call; other stores have no such lock, and there both may call, while the
answer that is read afterwards is one.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256
from typing import Any

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANSWER = "key string, model string, purpose string, attempt int, plain boolean, answer string, input_tokens long, cached_tokens long, output_tokens long"


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Once:
    """A provider whose answers stay under path. patience: seconds after which another task's unfinished call is made again."""

    provider: Callable[[Any], Any]
    path: str
    model: str = ""
    purpose: str = ""
    patience: float = 300

    def __call__(self, prompt):
        return self.ask(prompt)

    def ask(self, prompt, attempt: int = 0):
        """The answer to a prompt; another attempt is another call. A tuple (answer, input, cached, output tokens) comes back as one."""
        key = sha256(json.dumps([self.model, self.purpose, prompt, attempt], ensure_ascii=False).encode()).hexdigest()
        store, top = store_of(self.path)
        folder = f"{top}/{key[:2]}"
        name, lock = f"{folder}/{key}.json", f"{folder}/.{key}.lock"
        store.create_dir(folder)
        while True:
            found = self._read(store, name)
            if found is not None:
                return found
            if not isinstance(store, fs.LocalFileSystem) or self._locked(lock):
                break
            time.sleep(0.05)
        try:
            found = self._read(store, name)  # another task may have ended between
            if found is None:
                said = self.provider(prompt)
                answer, *tokens = said if isinstance(said, tuple) else (said, None, None, None)
                row = {"key": key, "model": self.model, "purpose": self.purpose, "attempt": attempt, "plain": not isinstance(said, tuple), "answer": json.dumps(answer, ensure_ascii=False), **dict(zip(("input_tokens", "cached_tokens", "output_tokens"), tokens, strict=True))}
                new = f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(new) as out:
                    out.write(json.dumps(row, ensure_ascii=False).encode())
                store.move(new, name)
                found = self._read(store, name)
            return found
        finally:
            if isinstance(store, fs.LocalFileSystem) and os.path.exists(lock):
                os.unlink(lock)

    def _locked(self, lock: str) -> bool:
        try:
            os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
            return True
        except FileExistsError:
            try:
                if time.time() - os.stat(lock).st_mtime > self.patience:
                    os.unlink(lock)
            except FileNotFoundError:
                pass
            return False

    @staticmethod
    def _read(store: fs.FileSystem, name: str):
        if store.get_file_info(name).type != fs.FileType.File:
            return None
        with store.open_input_stream(name) as f:
            row = json.loads(f.read())
        answer = json.loads(row["answer"])
        return answer if row["plain"] else (answer, row["input_tokens"], row["cached_tokens"], row["output_tokens"])


def answers(spark: SparkSession, path: str) -> DataFrame:
    """The table of answers (ANSWER)."""
    return spark.read.schema(ANSWER).json(f"{path}/*/*.json")


def tokens(spark: SparkSession, path: str) -> DataFrame:
    """(model, purpose, calls, input_tokens, cached_tokens, output_tokens): each call is booked once, however often its task ran."""
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "cached_tokens", "output_tokens")]
    return answers(spark, path).dropDuplicates(["key"]).groupBy("model", "purpose").agg(F.count(F.lit(1)).alias("calls"), *total)
