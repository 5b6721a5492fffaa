"""URL filters: a memory-mapped sorted array of 64-bit digests, probed by vectorised binary search.

The rule file holds the sorted xxhash keys, the offsets of the full strings, one verdict byte for each rule and the strings.
A probe finds its key with numpy's binary search over the mapped file and then compares the stored string, so a hash
collision can't give a wrong answer. The file is written to the shared folder and goes to every executor with
SparkContext.addFile, which also reaches executors that join later; its size is that of the rules and doesn't depend on the
pages.

Defined results. Null url, or no "://": host and path are empty, no rule, default verdict. Empty path: only rules with an
empty path can fit. Repeated rows: each is judged. Extra columns of the input are ignored, so their names can't clash.
Two rules of equal total length that both fit: the longer host wins.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from inkwell.llm import common

#: The rules of the query (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
VERDICTS = ("allow", "block")
_URL = re.compile(rb"://([^/?#]*)([^?#]*)")


class DigestArray:
    """Read side of the rule file."""

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        n = self.n = int(raw[:8].view("<u8")[0])
        self.keys = raw[8 : 8 + 8 * n].view("<u8")
        self.offsets = raw[8 + 8 * n : 16 + 16 * n].view("<u8")
        self.values = raw[16 + 16 * n : 16 + 17 * n]
        self.blob = raw[16 + 17 * n :]

    @staticmethod
    def pack(entries: Iterable[tuple[bytes, int]]) -> bytes:
        rows = sorted((xxhash.xxh64_intdigest(s), s, v) for s, v in dict(entries).items())
        strings = [s for _, s, _ in rows]
        return b"".join((
            np.array([len(rows)], "<u8").tobytes(),
            np.array([k for k, _, _ in rows], "<u8").tobytes(),
            np.concatenate(([0], np.cumsum([len(s) for s in strings], dtype=np.int64))).astype("<u8").tobytes(),
            bytes(v for _, _, v in rows),
            b"".join(strings),
        ))

    def string(self, i: int) -> bytes:
        return self.blob[int(self.offsets[i]) : int(self.offsets[i + 1])].tobytes()

    def find(self, probes: list[bytes], digest=xxhash.xxh64_intdigest) -> np.ndarray:
        """Position of each probe, -1 where it is absent. Equal keys of different strings stand side by side and are all compared."""
        keys = np.fromiter(map(digest, probes), dtype=np.uint64, count=len(probes))
        at = np.searchsorted(self.keys, keys)
        found = np.full(len(probes), -1, np.int64)
        inside = np.flatnonzero(at < self.n)
        for i in inside[self.keys[at[inside]] == keys[inside]]:
            j = int(at[i])
            while j < self.n and self.keys[j] == keys[i]:
                if self.string(j) == probes[i]:
                    found[i] = j
                    break
                j += 1
        return found


def split_url(url: bytes | None) -> tuple[bytes, bytes]:
    m = _URL.search(url) if url else None
    return (m[1].lower(), m[2]) if m else (b"", b"")


def probes_of(host: bytes, path: bytes, path_lengths: list[int]) -> list[bytes]:
    """Every string that a fitting rule can have, the longest host first."""
    labels = host.split(b".") if host else []
    suffixes = [b".".join(labels[i:]) for i in range(len(labels))]
    return [s + path[:n] for s in suffixes for n in path_lengths if n <= len(path)]


def filter_urls(pages: DataFrame, rules=RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) for every row; see the module's docstring for the edge cases."""
    spark = pages.sparkSession
    if id_col.lower() in ("host", "path", "rule", "verdict"):
        raise ValueError(f"id_col {id_col!r} is the name of a column of the result; rename it first")
    packed = DigestArray.pack(((h + p).encode(), VERDICTS.index(v)) for v, h, p in rules)
    lengths = sorted({len(p.encode()) for _, _, p in rules}, reverse=True)
    name = f"rules-{hashlib.sha256(packed).hexdigest()}.bin"
    if not any(x.endswith(f"/{name}") for x in spark.sparkContext.listFiles):
        with tempfile.TemporaryDirectory() as folder:  # the driver's own copy; Spark serves the file from the driver to the executors
            local = os.path.join(os.path.abspath(folder), name)
            with open(local, "wb") as f:
                f.write(packed)
            path = f"{common.shared_dir(spark)}/{name}"
            common.upload(spark, local, path)
        spark.sparkContext.addFile(path)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestArray(SparkFiles.get(name))
        for batch in batches:
            parts = [split_url(u) for u in common.utf8(batch, "url")]
            probes, owner = [], []
            for i, (host, path) in enumerate(parts):
                own = probes_of(host, path, lengths)
                probes += own
                owner += [i] * len(own)
            at = index.find(probes)
            best: dict[int, int] = {}
            for k in np.flatnonzero(at >= 0):
                i = owner[k]
                if i not in best or len(probes[k]) > len(probes[best[i]]):
                    best[i] = k
            rule = [probes[best[i]] if i in best else None for i in range(len(parts))]
            verdict = [VERDICTS[index.values[at[best[i]]]] if i in best else default for i in range(len(parts))]
            text = lambda xs: pa.array(xs, pa.binary()).cast(pa.string())
            yield pa.record_batch([batch.column(0), text([h for h, _ in parts]), text([p for _, p in parts]), text(rule), pa.array(verdict)], names=[id_col, "host", "path", "rule", "verdict"])

    source = pages.select(pages[id_col].alias(id_col), pages[url_col].cast("string").alias("url"))
    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(common.tidied(judge), f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def query(spark, sf_dir: str) -> DataFrame:
    return filter_urls(common.read(spark, sf_dir, "pages"))


ORACLE = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
