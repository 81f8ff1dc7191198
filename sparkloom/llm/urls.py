"""Operator 5: URL rules in a sorted digest array, memory-mapped by each worker."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F


def write_digest_array(rules: Iterable[tuple[str, str, str]], path: str) -> None:
    """One file: sorted 64-bit digests, then offsets, verdicts and whole strings of the rules (host, path, verdict).

    Rules that repeat keep the last verdict. Hosts and paths are matched as bytes of their UTF-8.
    """
    last = {f"{host}\n{start}": verdict for host, start, verdict in rules}
    texts = [t.encode() for t in last]
    digests = np.fromiter((xxhash.xxh64_intdigest(t) for t in texts), np.uint64, len(texts))
    order = np.argsort(digests, kind="stable")
    names = sorted(set(last.values()))
    verdicts = np.array([names.index(v) for v in last.values()], np.int64)[order]
    ordered = [texts[i] for i in order]
    offsets = np.cumsum([0, *map(len, ordered)]).astype(np.int64)
    head = json.dumps({"n": len(texts), "verdicts": names, "lengths": sorted({len(t.split(b"\n", 1)[1]) for t in texts})}).encode()
    with open(path, "wb") as f:
        f.write(np.array([len(head)], np.int64).tobytes() + head + b" " * (-len(head) % 8))
        for part in (digests[order], offsets, verdicts):
            f.write(part.tobytes())
        f.write(b"".join(ordered))


class DigestArray:
    """The file mapped read-only: pages are shared by an executor's workers and read on demand."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        size = int(data[:8].view(np.int64)[0])
        head = json.loads(data[8 : 8 + size].tobytes())
        at, n = 8 + size + -size % 8, head["n"]
        self.verdict_names, self.path_lengths = head["verdicts"], head["lengths"]
        self.digests = data[at : at + 8 * n].view(np.uint64)
        self.offsets = data[at + 8 * n : at + 16 * n + 8].view(np.int64)
        self.verdicts = data[at + 16 * n + 8 : at + 24 * n + 8].view(np.int64)
        self.texts = data[at + 24 * n + 8 :]

    def find(self, texts: list[bytes]) -> np.ndarray:
        """The place of each text, or -1: binary search by digest, then the stored string itself is compared."""
        out = np.full(len(texts), -1)
        if not len(self.digests) or not texts:
            return out
        wanted = np.fromiter((xxhash.xxh64_intdigest(t) for t in texts), np.uint64, len(texts))
        at = np.searchsorted(self.digests, wanted)
        for i in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == wanted).tolist():
            k = int(at[i])
            while k < len(self.digests) and self.digests[k] == wanted[i]:
                if self.texts[self.offsets[k] : self.offsets[k + 1]].tobytes() == texts[i]:
                    out[i] = k
                    break
                k += 1
        return out


def _judged(name: str, default: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = DigestArray(SparkFiles.get(name))
        for batch in batches:
            probes, owner = [], []
            for i, (host, path) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())):
                raw = path.encode()
                starts = [raw[:n] for n in rules.path_lengths if n <= len(raw)]
                rest = host
                while True:
                    for start in starts:
                        probes.append(rest.encode() + b"\n" + start)
                        owner.append(i)
                    rest = rest.partition(".")[2]
                    if not rest:
                        break
            found = rules.find(probes)
            best: dict[int, tuple[int, bytes, int]] = {}
            for k in np.flatnonzero(found >= 0).tolist():
                this = (len(probes[k]), probes[k], int(found[k]))
                if owner[k] not in best or this > best[owner[k]]:
                    best[owner[k]] = this
            rule = [best[i][1].replace(b"\n", b"").decode() if i in best else None for i in range(batch.num_rows)]
            verdict = [rules.verdict_names[int(rules.verdicts[best[i][2]])] if i in best else default for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["id", "host", "path", "rule", "verdict"])

    return rows


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The id, host, path, rule (like ``net/``, or null) and verdict of every row.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or
    the end. A null url, or one without ``://``, has both empty. A rule (host, path, verdict) fits its host and all
    subdomains if the path starts with the rule's; of several the longest host and path wins, ``default`` if none fits.

    The rules are written once to a sorted digest array, which Spark ships to each executor as a file; workers map it
    and probe every pair of a host's suffix and a path start of a length that some rule has, by vectorised binary
    search, and compare the stored strings. Nothing is shuffled. Repeated and null ids are kept. Empty tables give no
    rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    name = f"sparkloom-rules-{uuid.uuid4().hex}"
    path = os.path.join(os.path.realpath(tempfile.mkdtemp()), name)
    write_digest_array(rules, path)
    spark.sparkContext.addFile(path)
    u = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.regexp_replace(u, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = pages.select(F.col(id_col).alias("id"), host.alias("host"), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"))
    kind = dict(pages.dtypes)[id_col]
    return parts.mapInArrow(_judged(name, default), f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
