"""URL filters: rules in a memory-mapped array of sorted digests, probed by vectorised binary search."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import write_shared

#: Up to here Java's and RE2's regular expressions agree: the first "://", the host, the path.
HOST, PATH = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str]  # verdict, host followed by the path's prefix


def store_bytes(rules: Sequence[Rule]) -> bytes:
    """The file: row count, (host length, path length) pairs; then keys, string offsets, verdicts and strings, ordered by key."""
    unique = dict(reversed([(text, verdict) for verdict, text in rules]))  # the first of equal rules counts
    rows = sorted((xxhash.xxh64_intdigest(text.encode()), text.encode(), verdict == "block") for text, verdict in unique.items())
    lengths = sorted({(text.index("/"), len(text) - text.index("/")) for text in unique})
    parts = [
        np.array([len(rows), len(lengths), *(n for pair in lengths for n in pair)], dtype=np.uint64),
        np.array([r[0] for r in rows], dtype=np.uint64),
        np.cumsum([0, *(len(r[1]) for r in rows)], dtype=np.uint64),
        np.array([r[2] for r in rows], dtype=np.uint8),
    ]
    return b"".join([*(x.tobytes() for x in parts), *(r[1] for r in rows)])


class Store:
    """A rule file, memory-mapped: the pages that probes touch are all that is read."""

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        n, k = (int(x) for x in raw[:16].view(np.uint64))
        #: The path lengths that rules of a host length have.
        self.paths: dict[int, list[int]] = {}
        for host, path_ in raw[16 : 16 + 16 * k].view(np.uint64).reshape(-1, 2).tolist():
            self.paths.setdefault(host, []).append(path_)
        at = 16 + 16 * k
        self.keys = raw[at : at + 8 * n].view(np.uint64)
        self.ends = raw[at + 8 * n : at + 16 * n + 8].view(np.uint64)
        self.blocks = raw[at + 16 * n + 8 : at + 17 * n + 8]
        self.strings = raw[at + 17 * n + 8 :]

    def find(self, digests: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """The row of each text, -1 where there is none; equal digests of other strings are passed over."""
        out = np.full(len(texts), -1, dtype=np.int64)
        if not len(self.keys):
            return out
        places = np.searchsorted(self.keys, digests)
        hit = np.flatnonzero(self.keys[np.minimum(places, len(self.keys) - 1)] == digests)
        for i in hit:
            row = int(places[i])
            while row < len(self.keys) and self.keys[row] == digests[i]:
                if self.strings[int(self.ends[row]) : int(self.ends[row + 1])].tobytes() == texts[i]:
                    out[i] = row
                    break
                row += 1
        return out


@functools.lru_cache(maxsize=4)
def opened(name: str) -> Store:
    return Store(SparkFiles.get(name))


def candidates(host: str, path: str, paths: dict[int, list[int]]) -> list[bytes]:
    """Every string of ``host`` or a parent domain and a prefix of ``path`` that has the lengths of a rule, longest
    first, of two as long the one with the longer host. There are no more than the rules have lengths, each no longer
    than the longest rule, whatever the URL."""
    longest = max(paths, default=0)
    found = []
    at = len(host)
    while at > 0 and len(host) - at <= longest:
        at = host.rfind(".", 0, at)
        suffix = len(host) - at - 1
        found += [(suffix + n, suffix, host[at + 1 :] + path[:n]) for n in paths.get(suffix, ()) if n <= len(path)]
        if at < 0:
            break
    return [text.encode() for _, _, text in sorted(found, reverse=True)]


def judged(store: Store, hosts: Sequence[str], paths: Sequence[str]) -> list[tuple[str | None, str]]:
    texts: list[bytes] = []
    owner: list[int] = []
    for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
        own = candidates(host, path, store.paths) if host else []
        texts += own
        owner += [i] * len(own)
    rows = store.find(np.fromiter(map(xxhash.xxh64_intdigest, texts), dtype=np.uint64, count=len(texts)), texts)
    out: list[tuple[str | None, str]] = [(None, "allow")] * len(hosts)
    for j in np.flatnonzero(rows >= 0)[::-1]:  # the longest comes last and stays
        out[owner[j]] = texts[j].decode(), "block" if store.blocks[rows[j]] else "allow"
    return out


def judge_urls(pages: DataFrame, rules: Sequence[Rule], *, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    ``rules`` are (verdict, host + path prefix) pairs; of those that fit the host or a parent domain of it
    and start the path, the longest decides, then the one of the longer host, of equal rules the first. Without one the
    URL is allowed.
    Null URL, or none with "://": empty host and path, no rule. Repeated rows and null ids are ordinary rows, an empty
    table gives none; a URL of any length is probed for as many strings as the rules have lengths. The rule file
    lies in the shared folder, goes to every executor once and is mapped there; it is as large as the rules and does not grow with the
    pages. Other columns are ignored.
    """
    spark: SparkSession = pages.sparkSession
    name = f"url-rules-{uuid.uuid4().hex}.bin"
    spark.sparkContext.addFile(write_shared(spark, name, store_bytes(rules)))

    def probe(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = judged(opened(name), part["host"], part["path"])
            part["rule"] = pd.Series([r for r, _ in found], dtype=object, index=part.index)
            part["verdict"] = pd.Series([v for _, v in found], dtype=object, index=part.index)
            yield part

    address = F.coalesce(F.col(url), F.lit(""))
    parsed = pages.select(
        F.col(id_col).alias("page_id"),
        F.translate(F.regexp_extract(address, HOST, 1), UPPER, LOWER).alias("host"),
        F.regexp_extract(address, PATH, 1).alias("path"),
    )
    kind = parsed.schema["page_id"].dataType.simpleString()
    return parsed.mapInPandas(probe, f"page_id {kind}, host string, path string, rule string, verdict string")
