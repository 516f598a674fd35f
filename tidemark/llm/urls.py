"""URL rules behind a sorted digest array.

A rule is a host and a path with a verdict.  It fits that host and its
subdomains where the url's path starts with the rule's; the longest rule that
fits decides.  The rules are kept in one file: the 64-bit xxhash digests of
their strings, ascending, and beside them the strings and verdicts.  Each worker
maps the file into memory, makes the candidate strings of its urls (each suffix
of the host by each path length that rules have), probes all their digests in a
vectorised binary search and confirms every digest found on the stored string,
so that a collision of digests decides nothing.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end,
with A-Z lowered; the path goes on from there up to ``?``, ``#`` or the end.
Null urls and such without ``://`` have neither (both empty): no rule fits them.
Where no rule fits, the verdict is the default (allow: the file is a block list
with exceptions).  Of rules alike in host and path the last counts.  Every row has a
result, also repeated ones; an empty table gives an empty one.  A url of any length is
judged whole.  Only the id and url columns are read, so others may have any name.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import struct
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame

#: host, path, verdict (fixed values).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
LARGEST_FILE = 2 << 30
MAGIC = b"URLRULE1"
_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def write_index(path: str, rules: Iterable[tuple[str, str, str]]) -> None:
    """The file: magic, count, path lengths, digests, ends of strings, host lengths, verdicts, strings."""
    held = {}
    for host, start, verdict in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"{verdict!r} is no verdict")
        held[host.translate(_UPPER), start] = verdict
    keys = sorted(((xxhash.xxh64_intdigest(f"{h}\n{p}".encode()), h, p) for h, p in held))
    texts = [f"{h}\n{p}".encode() for _, h, p in keys]
    sizes = sorted({len(p) for _, _, p in keys})
    with open(path, "wb") as out:
        out.write(MAGIC + struct.pack("<qq", len(keys), len(sizes)))
        out.write(np.array(sizes, "<i8").tobytes())
        out.write(np.array([d for d, _, _ in keys], "<u8").tobytes())
        out.write(np.cumsum([0, *map(len, texts)]).astype("<i8").tobytes())
        out.write(np.array([held[h, p] == "block" for _, h, p in keys], "u1").tobytes())
        out.write(b"".join(texts))


class Index:
    """A mapped file of rules."""

    def __init__(self, path: str) -> None:
        data = np.memmap(path, np.uint8, "r")
        if data[:8].tobytes() != MAGIC:
            raise ValueError(f"{path} holds no rules")
        n, sizes = struct.unpack("<qq", data[8:24].tobytes())
        at = 24
        self.sizes = data[at : at + 8 * sizes].view("<i8").tolist()
        at += 8 * sizes
        self.digests = data[at : at + 8 * n].view("<u8")
        at += 8 * n
        self.ends = data[at : at + 8 * (n + 1)].view("<i8")
        at += 8 * (n + 1)
        self.block = data[at : at + n]
        self.text = data[at + n :]

    def probe(self, keys: list[bytes]) -> list[int]:
        """The place of each key's rule, or -1."""
        digest = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        low = np.searchsorted(self.digests, digest, "left")
        high = np.searchsorted(self.digests, digest, "right")
        out = [-1] * len(keys)
        for k in np.flatnonzero(low < high).tolist():
            for i in range(int(low[k]), int(high[k])):  # equal digests stand together
                if self.text[self.ends[i] : self.ends[i + 1]].tobytes() == keys[k]:
                    out[k] = i
        return out

    def rule(self, i: int) -> tuple[str, str]:
        text = self.text[self.ends[i] : self.ends[i + 1]].tobytes().decode()
        return text.replace("\n", "", 1), "block" if self.block[i] else "allow"


def parse(url: str | None) -> tuple[str, str]:
    """Host and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = re.search(r"[/?#]", rest)
    host = rest[: end.start()] if end else rest
    path = rest[len(host) :]
    stop = re.search(r"[?#]", path)
    return host.translate(_UPPER), path[: stop.start()] if stop else path


def candidates(host: str, path: str, sizes: list[int]) -> list[bytes]:
    """The rules that may fit, as keys; longer hosts first, then longer paths."""
    labels = host.split(".")
    fits = [path[:n] for n in reversed(sizes) if n <= len(path)]
    return [f"{suffix}\n{start}".encode("utf-8", "surrogatepass") for suffix in (".".join(labels[i:]) for i in range(len(labels))) if suffix for start in fits]


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id_col, host, path, rule (host and path of the rule, else null), verdict; one row for each row of pages.

    The file of rules goes to the executors with SparkContext.addFile (one that was lost
    gets it again with its successor); its size is checked against LARGEST_FILE.
    """
    name = f"rules-{uuid.uuid4().hex}.bin"
    folder = tempfile.mkdtemp(prefix="rules-")  # the driver's own; executors fetch the file from it until the application ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    local = os.path.join(folder, name)
    write_index(local, rules)
    if os.path.getsize(local) > LARGEST_FILE:
        raise ValueError("too many rules for one file")
    pages.sparkSession.sparkContext.addFile(local)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(SparkFiles.get(name))
        for batch in batches:
            parts = [parse(x) for x in batch.column(1).to_pylist()]
            keys = [candidates(h, p, index.sizes) for h, p in parts]
            places = iter(index.probe([k for own in keys for k in own]))
            found = []
            for own in keys:
                fits = [i for i in (next(places) for _ in own) if i >= 0]
                found.append(max((index.rule(i) for i in fits), key=lambda r: len(r[0]), default=(None, default)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())],
                [id_col, "host", "path", "rule", "verdict"],
            )

    return pages.select(id_col, url_col).mapInArrow(run, f"{id_col} {kind}, host string, path string, rule string, verdict string")
