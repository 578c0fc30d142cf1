"""Packing token sequences by the sum-of-squares rule, tracked in an array of fill levels."""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

LENGTH = 2048
OPEN = 1024  # partly filled windows that a task keeps at most
CACHED = 700_000  # chunks of a generation; a worker keeps the ids of two

#: Latin letters whose lower case is one letter, then marks that never split.
_LATIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u01ef\u01f1-\u024f]+)([.,;:!?]*)")
#: Fixed by the tokenizer: what its pre-tokenizer keeps.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTROLS = "\x1c\x1d\x1e\x1f"  # white space to str.split() only

Piece = tuple[int, int, bytes]  # document's number, ids of it before, ids


def byte_characters() -> dict[int, str]:
    """The character that byte-level tokenizers write for each byte: itself if it prints, else the next from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + n) for n, b in enumerate(rest)}


class Chunks(dict):
    """The ids of chunks; one that is asked for the first time comes from the generation before, or is encoded."""

    def __init__(self, encode: Callable[[str], bytes], older: dict[str, bytes]) -> None:
        self.encode, self.older = encode, older

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older[chunk] if dict.__contains__(self.older, chunk) else self.encode(chunk)
        self[chunk] = ids
        return ids


class WholeEncoder:
    """Any tokenizer, asked for each text."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


class ChunkEncoder:
    """A tokenizer that drops white space and never joins what it separates: chunks are encoded once each.

    Most chunks are a Latin word and a few marks. Their letters are one piece, which goes to the tokenizer's
    merge model as it is; other chunks take its whole way.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.characters = byte_characters()
        self.cache = Chunks(self.chunk, {})
        self.marks: dict[str, list[int]] = {"": []}

    def chunk(self, text: str) -> bytes:
        found = _LATIN.fullmatch(text)
        if found is None:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        core, after = found.groups()
        if after not in self.marks:
            if len(self.marks) > 10_000:
                self.marks = {"": []}
            self.marks[after] = self.tokenizer.encode(after, add_special_tokens=False).ids
        piece = core.lower()
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.characters)
        return array("I", [t.id for t in self.merge(piece)] + self.marks[after]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHED:
            self.cache.older = {}
            self.cache = Chunks(self.chunk, self.cache)
        get = self.cache.__getitem__
        return [b"".join(map(get, t.split() if not any(c in t for c in CONTROLS) else filter(None, _split_spaces(t)))) for t in texts]


def _split_spaces(text: str) -> list[str]:
    """At white space as the tokenizer sees it: 1C-1F are ordinary characters."""
    hidden = {c: 0xE000 + c for c in range(0x1C, 0x20)}
    if any(chr(v) in text for v in hidden.values()):
        return [text]
    shown = {v: k for k, v in hidden.items()}
    return [c.translate(shown) for c in text.translate(hidden).split()]


def cuts_at_space(path: str) -> bool:
    """Whether a tokenizer file describes what ``ChunkEncoder`` needs: text in NFC with white space as blanks, lower-cased;
    split into words, marks and single digits, white space removed; then byte-level merges."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    parts = lambda name, inner: [p["type"] for p in (told.get(name) or {}).get(inner, [])]
    splits = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        parts("normalizer", "normalizers") == ["NFC", "Replace", "Lowercase"]
        and parts("pre_tokenizer", "pretokenizers") == ["Split", "ByteLevel"]
        and (splits[0]["pattern"], splits[0]["behavior"], splits[0]["invert"]) == ({"Regex": WORDS}, "Removed", True)
        and told["model"]["type"] == "BPE"
    )


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder | WholeEncoder:
    return ChunkEncoder(path) if cuts_at_space(path) else WholeEncoder(path)


class Windows:
    """Windows of ``length`` ids, filled online.

    ``levels[h]`` counts the open windows filled to h. A piece of s ids goes to the level h (0: a new window)
    for which the sum of squared counts grows least by moving one window from h to h + s; of several the
    fullest. A window with room for no more than ``slack`` ids leaves the levels: the next document's first ids fill
    it. No more than ``most`` windows stay open: beyond that the fullest is filled in this way. At the end the open
    ones are joined and cut anew into full windows.
    """

    def __init__(self, length: int, most: int = OPEN, slack: int | None = None) -> None:
        self.length, self.most = length, most
        self.closes = length - (length // 16 if slack is None else slack)
        self.levels = np.zeros(length + 1, dtype=np.int64)
        self.at: dict[int, list[list[Piece]]] = {}
        self.open = 0
        self.full: list[list[Piece]] = []
        self.short: list[Piece] = []  # the window that the next document fills
        self.room = 0

    def level_for(self, size: int) -> int:
        used = np.flatnonzero(self.levels[1 : self.length - size + 1]) + 1
        new = 2 * self.levels[size] + 1 if size < self.closes else 0
        if not len(used):
            return 0
        after = used + size
        growth = 1 - 2 * self.levels[used] + np.where(after < self.closes, 2 * self.levels[np.minimum(after, self.length)] + 1, 0)
        best = len(used) - 1 - int(np.argmin(growth[::-1]))
        return int(used[best]) if growth[best] <= new else 0

    def add(self, doc: int, ids: bytes) -> None:
        start, width = 0, 4 * self.length
        if self.room:
            taken = ids[: 4 * self.room]
            self.short.append((doc, 0, taken))
            start, ids = len(taken) // 4, ids[len(taken) :]
            self.room -= start
            if not self.room:
                self.full.append(self.short)
                self.short = []
        whole = len(ids) // width * width
        for k in range(0, whole, width):
            self.full.append([(doc, start + k // 4, ids[k : k + width])])
        if len(ids) > whole:
            self.put((doc, start + whole // 4, ids[whole:]))
        if self.open > self.most and not self.room:
            self.shorten(int(np.flatnonzero(self.levels)[-1]), [])

    def put(self, piece: Piece) -> None:
        size = len(piece[2]) // 4
        h = self.level_for(size)
        if h + size >= self.closes:
            self.shorten(h, [piece])
            return
        window = [*self.taken(h), piece]
        self.levels[h + size] += 1
        self.at.setdefault(h + size, []).append(window)
        self.open += 1

    def taken(self, h: int) -> list[Piece]:
        if not h:
            return []
        self.levels[h] -= 1
        self.open -= 1
        return self.at[h].pop()

    def shorten(self, h: int, more: list[Piece]) -> None:
        """A window of level h and ``more`` is full, or waits for the next document."""
        window = self.taken(h) + more
        room = self.length - h - sum(len(p[2]) // 4 for p in more)
        if room:
            self.short, self.room = window, room
        else:
            self.full.append(window)

    def recut(self) -> list[Piece]:
        """Joins the open windows, fullest first, into full ones; returns what is left over, less than one window."""
        window: list[Piece] = []
        room = self.length
        for pieces in [self.short, *(w for h in sorted(self.at, reverse=True) for w in self.at[h])]:
            for doc, start, ids in pieces:
                while ids:
                    taken = ids[: 4 * room]
                    window.append((doc, start, taken))
                    start, ids, room = start + len(taken) // 4, ids[len(taken) :], room - len(taken) // 4
                    if not room:
                        self.full.append(window)
                        window, room = [], self.length
        self.levels[:], self.at, self.open, self.short, self.room = 0, {}, 0, [], 0
        return window

    def close(self) -> None:
        """The last rest is cut into windows whose lengths are powers of two, so that nothing is padded."""
        rest = self.recut()
        left = sum(len(p[2]) for p in rest) // 4
        while left:
            size = 1 << (left.bit_length() - 1)
            window, room = [], size
            while room:
                doc, start, ids = rest.pop(0)
                taken = ids[: 4 * room]
                window.append((doc, start, taken))
                room -= len(taken) // 4
                if len(taken) < len(ids):
                    rest.insert(0, (doc, start + len(taken) // 4, ids[len(taken) :]))
            self.full.append(window)
            left -= size


def pack(documents: DataFrame, tokenizer: str, *, length: int = LENGTH, end_id: int = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its text's ids and ``end_id``; null or empty text is ``end_id`` alone. Full runs of
    ``length`` ids are windows of their own; what remains is placed by ``Windows``, each task packing the rows
    it reads in their order, without a shuffle. A sequence's number holds the task's number, so a task that
    runs again gives the same. Sequences are full, but for each task's last rest. Repeated rows and null
    ids are documents of their own; of levels that serve equally the fullest is taken; an empty table gives no rows.
    Other columns are ignored. ``tokenizer`` is a tokenizer file; whole texts go to it unless it lower-cases, drops
    white space and merges bytes, when equal chunks between white space are encoded once.
    """
    kind = documents.schema[id_col].dataType
    ddl = f"doc_id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 33
        windows, ids_of, tokens, number, sequence = Windows(length), {}, {}, 0, 0
        encode = encoder(tokenizer).encode
        end = np.array([end_id], dtype="<u4").tobytes()
        left: dict[int, int] = {}

        def rows() -> pa.RecordBatch:
            nonlocal sequence
            columns: list[list] = [[] for _ in range(7)]
            for window in windows.full:
                offset = 0
                for doc, start, ids in window:
                    n = len(ids) // 4
                    for c, v in zip(columns, (ids_of[doc], start, n, ids, tokens[doc], task + sequence, offset), strict=True):
                        c.append(v)
                    offset += n
                    left[doc] -= n
                    if not left[doc]:
                        del left[doc], ids_of[doc], tokens[doc]
                sequence += 1
            windows.full = []
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        id_type = pa.int64()
        for part in parts:
            id_type = part.column(0).type
            for at in range(0, part.num_rows, 256):
                some = part.slice(at, 256)
                for doc_id, ids in zip(some.column(0).to_pylist(), encode([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    ids_of[number], tokens[number] = doc_id, len(ids) // 4 + 1
                    left[number] = tokens[number]
                    windows.add(number, ids + end)
                    number += 1
                yield rows()
        windows.close()
        if windows.full:
            yield rows()

    return documents.select(id_col, text).mapInArrow(run, ddl)


def with_checksum(pieces: DataFrame) -> DataFrame:
    return pieces.withColumn("ids_crc32", F.crc32("ids"))
