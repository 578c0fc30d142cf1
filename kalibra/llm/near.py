"""MinHash near-dedup by a chosen-path set similarity join.

In each tree a document walks down from the root: every node chooses the minwise token that tells its children apart,
so that a pair shares a path as often as it shares the tokens chosen on it. Small nodes are compared exhaustively on
signatures. The sets of nodes that stay too large walk further, in fresh trees, as many as the longer path needs, or are
compared block by block where that takes no more rows. Every link that counts is confirmed on the full shingle sets.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import materialise
from .words import ascii_lower, words

WIDTH = 5  # words of a shingle
TOKENS = 192  # minwise tokens of a signature, one byte each
DEPTH = 6  # tokens that choose a first node
DEEPER = 2  # tokens that each level adds
MISSED = 4e-6  # chance that a pair at the threshold shares no first node; all further levels together add as much
LEAF = 1000  # documents of a node that are compared exhaustively
FEW = 8  # a node of so many gives all its pairs at once
MARGIN = 0.14  # below the threshold; the estimate of a pair at 0.8 is lower with a probability of 2e-6
SURE = 0.05  # above the threshold, first links come from pairs estimated so high
UNIT = 1_000_000  # shingles of the sets that one confirming group holds, about

_rng = np.random.default_rng(41)
_XOR = _rng.integers(0, 2**32, TOKENS, dtype=np.uint64).astype(np.uint32)
_ODD = (_rng.integers(0, 2**31, TOKENS, dtype=np.uint64) * 2 + 1).astype(np.uint32)


def missed(percent: int, depth: int, trees: int) -> float:
    """The chance that a pair at the threshold shares no path of ``depth`` tokens in ``trees`` trees. All trees read one
    signature, so this is a mean over the number of tokens that the pair shares in it."""
    p = percent / 100 + (1 - percent / 100) / 256
    return sum(comb(TOKENS, n) * p**n * (1 - p) ** (TOKENS - n) * (1 - comb(n, depth) / comb(TOKENS, depth)) ** trees for n in range(TOKENS + 1))


@functools.cache
def trees_for(percent: int, level: int) -> int:
    """The trees of a level; each level after the first may miss half of what the one before it may."""
    depth, chance = DEPTH + DEEPER * level, MISSED / 2**level
    low, high = 0, 1
    while missed(percent, depth, high) > chance:
        low, high = high, 2 * high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if missed(percent, depth, middle) > chance else (low, middle)
    return high


def walks(signatures: np.ndarray, trees: int, depth: int, level: int) -> np.ndarray:
    """The node (uint64) at which each signature ends in each tree, after ``depth`` steps from the root.

    A node's own number chooses the token that the step looks at. Tokens may be chosen twice on a path, so a pair
    shares one at least as often as ``missed`` has it.
    """
    at = np.broadcast_to(mixed(np.arange(trees, dtype=np.uint64) + np.uint64(level << 32)), (len(signatures), trees))
    rows = np.arange(len(signatures))[:, None]
    for _ in range(depth):
        token = signatures[rows, (at >> np.uint64(32)) % np.uint64(TOKENS)]
        at = mixed(at ^ token)
    return at


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB) + np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle sets as sorted 64-bit hashes; word hashes are remembered."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def set_of(self, text: str | None) -> np.ndarray:
        tokens = words(ascii_lower(text)) if text else []
        if not tokens:
            return np.zeros(0, dtype=np.uint64)
        known = self.known
        if len(known) > 300_000:
            known.clear()
        for w in {*tokens}.difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w.encode())
        h = np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        n = min(WIDTH, len(h))
        g = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            g = (g ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            g ^= g >> np.uint64(31)
        return np.unique(g)


def signature(hashes: np.ndarray) -> bytes:
    """One byte of each minwise token."""
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(TOKENS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 512):
        least = np.minimum(least, ((x[at : at + 512, None] ^ _XOR) * _ODD).min(axis=0))
    least *= np.uint32(0x85EBCA6B)
    return ((least ^ (least >> np.uint32(15))) & np.uint32(0xFF)).astype(np.uint8).tobytes()


def sketches(documents: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc_id, n, digest, signature); digest and signature are null where there is no word."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for part in parts:
            n, digests, signatures = [], [], []
            for t in part.column(1):
                s = shingler.set_of(t.as_py())
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                signatures.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], names=["doc_id", "n", "digest", "signature"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text).mapInArrow(run, f"doc_id {kind}, n long, digest binary, signature binary")


def crowded(paths: DataFrame) -> DataFrame:
    """Of paths(key, tree, node), those whose key several nodes share, with that number as ``size``."""
    shared = materialise(paths.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared-paths")
    return materialise(paths.join(shared, "key"), "tree-nodes")


def paths(sets: DataFrame, percent: int, level: int) -> DataFrame:
    """(key, tree, node): the node at which each set of ``sets(node, signature)`` ends in each tree of a level."""
    trees, depth = trees_for(percent, level), DEPTH + DEEPER * level

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, 200_000 // trees)
        for part in parts:
            for at in range(0, part.num_rows, step):
                some = part.slice(at, step)
                key = walks(signature_matrix(some.column(1)), trees, depth, level).view(np.int64)
                columns = [pa.array(key.ravel()), pa.array(np.tile(np.arange(trees, dtype=np.int32), len(key))), pa.array(np.repeat(some.column(0).to_numpy(), trees))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "tree", "node"])

    return sets.select("node", "signature").mapInArrow(run, "key long, tree int, node long")


def tiles(sets: DataFrame, blocks: int) -> DataFrame:
    """(key, tree, node): every two of the blocks to which the sets are dealt are one node."""
    own = sets.select("node", F.pmod(F.xxhash64("node", F.lit("block")), F.lit(blocks)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    return own.select(F.xxhash64(F.lit("tile"), F.least("own", "other"), F.greatest("own", "other")).alias("key"), F.lit(0).alias("tree"), "node")


def agreement(row: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated similarity: the share of equal tokens, less what bytes share by chance."""
    return ((row == others).mean(axis=1) - 1 / 256) * (256 / 255)


def forest(nodes: np.ndarray, signatures: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs estimated at ``least`` or more, the likeliest pairs first."""
    best = np.full(len(nodes), -1.0)
    parent = np.full(len(nodes), -1)
    outside = np.ones(len(nodes), dtype=bool)
    for _ in range(len(nodes)):
        i = int(np.argmax(np.where(outside, best, -2.0)))
        if best[i] >= least:
            yield nodes[parent[i]], nodes[i]
        outside[i] = False
        est = agreement(signatures[i], signatures)
        closer = outside & (est > best)
        best[closer], parent[closer] = est[closer], i


def compared(members: DataFrame, least: float, sure: float) -> DataFrame:
    """Pairs (a, b, key) of nodes that small tree nodes hold: of few members all whose estimate is ``least`` or more, of
    more a spanning forest of sure ones. Both are linear in the members."""

    def pairs(key: np.ndarray, node: np.ndarray, sig: np.ndarray) -> tuple[list, list, list]:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(key)]
        two = starts[ends - starts == 2]
        two = two[agreement(sig[two], sig[two + 1]) >= least]
        a, b, k = node[two].tolist(), node[two + 1].tolist(), key[two].tolist()
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if e - s < 3:
                continue
            if e - s > FEW:
                found = list(forest(node[s:e], sig[s:e], sure))
            else:
                found = [(node[i], node[j]) for i in range(s, e - 1) for j in np.flatnonzero(agreement(sig[i], sig[i + 1 : e]) >= least) + i + 1]
            a += [int(x) for x, _ in found]
            b += [int(y) for _, y in found]
            k += [int(key[s])] * len(found)
        return a, b, k

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def spend(columns: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs(*columns)], names=["a", "b", "key"])

        for part in parts:
            if not part.num_rows:
                continue
            own = [part.column(0).to_numpy(), part.column(1).to_numpy(), signature_matrix(part.column(2))]
            held = own if held is None else [np.concatenate(x) for x in zip(held, own, strict=True)]
            last = int(np.searchsorted(held[0], held[0][-1]))  # keys are sorted: the last node may go on
            if last:
                yield spend([x[:last] for x in held])
                held = [x[last:] for x in held]
        if held is not None and len(held[0]):
            yield spend(held)

    return members.select("key", "node", "signature").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, key long")


def signature_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, TOKENS)


def overlaps(sets: list[np.ndarray], pairs: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For (i, others): i, others and the sizes of the sets' intersections, all others at once."""
    flat = np.concatenate([*sets, np.zeros(1, dtype=np.uint64)])
    numbers = np.unique(flat, return_inverse=True)[1]
    ends = np.cumsum([len(s) for s in sets])
    starts = ends - [len(s) for s in sets]
    marked = np.zeros(numbers.max() + 1, dtype=np.int64)
    for i, others in pairs:
        own = numbers[starts[i] : ends[i]]
        marked[own] = 1
        yield i, others, np.array([marked[numbers[starts[j] : ends[j]]].sum() for j in others])
        marked[own] = 0


def in_tiles(members: DataFrame, heavy: DataFrame) -> DataFrame:
    """``members``, those of the nodes ``heavy(key, weight)`` dealt to tiles: each two of a node's blocks of about half
    a UNIT of shingles are a node of their own, so that no task holds more than two, or two larger sets."""
    own = members.join(heavy, "key", "left")
    blocks = F.greatest(F.lit(1), F.ceil(2 * F.coalesce("weight", F.lit(0)) / UNIT)).cast("int")
    block = F.pmod(F.xxhash64("node", F.lit("tile")), blocks).cast("int")
    dealt = own.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    key = F.when(F.col("weight").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
    return dealt.select(key.alias("key"), *[c for c in members.columns if c != "key"])


def linked_within(members: DataFrame, texts: DataFrame, least: float, percent: int, once: bool) -> DataFrame:
    """Links (a, b) between different labels of ``members(key, tree, node, n, signature, label)``, exact.

    All pairs of a node whose labels differ and whose estimate passes are compared on their full sets where the node
    is; what leaves is a link only if it joins labels that no link of the node has joined before, so the output is
    linear in the members. ``once``: a pair is compared in the first tree alone in which it meets.
    """
    heavy = materialise(members.groupBy("key").agg(F.sum("n").alias("weight")).where(F.col("weight") > UNIT), "heavy-nodes")
    members = materialise(in_tiles(members, heavy), "compared-nodes")
    needs = materialise(members.select("key", "node", "n").distinct(), "needs")
    groups = max(1, (needs.agg(F.sum("n")).first()[0] or 0) // UNIT)
    group = F.pmod("key", F.lit(groups)).cast("int")
    wanted = needs.select(group.alias("group"), "node").distinct().join(texts, "node")
    trees = trees_for(percent, 0)

    def check(own: pa.Table, some: pa.Table) -> pa.Table:
        shingler, first, more = Shingler(), {}, {}
        for node, t in zip(own["node"].to_pylist(), own["text"].to_pylist(), strict=True):
            (more.setdefault(node, []) if node in first else first.setdefault(node, [])).append(shingler.set_of(t))
        order = np.argsort(some["key"].to_numpy(), kind="stable")
        key, tree, node, label = (some[c].to_numpy()[order] for c in ("key", "tree", "node", "label"))
        sig = signature_matrix(some["signature"])[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else []
        ends = [*starts[1:], len(key)] if len(key) else []
        a, b = [], []
        for s, e in zip(starts, ends, strict=True):
            todo = []
            ends_at = walks(sig[s:e], trees, DEPTH, 0) if once else None
            for i in range(s, e - 1):
                j = np.flatnonzero((agreement(sig[i], sig[i + 1 : e]) >= least) & (label[i + 1 : e] != label[i])) + i + 1
                if once and len(j):
                    j = j[~(ends_at[i - s, : tree[i]] == ends_at[j - s, : tree[i]]).any(axis=1)]
                if len(j):
                    todo.append((i - s, j - s))
            if not todo:
                continue
            sets = [first[n][0] for n in node[s:e].tolist()]
            size = np.array([len(x) for x in sets])
            root = {int(x): int(x) for x in label[s:e]}

            def find(x: int, root: dict[int, int] = root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for i, others, both in overlaps(sets, todo):
                linked = 100 * both >= percent * (size[i] + size[others] - both)
                for n, j in enumerate(others.tolist()):
                    x, y = find(int(label[s + i])), find(int(label[s + j]))
                    u, v = int(node[s + i]), int(node[s + j])
                    if x != y and (linked[n] or (u in more or v in more) and any(similar(p, q, percent) for p in first[u] + more.get(u, []) for q in first[v] + more.get(v, []))):
                        root[max(x, y)] = min(x, y)
                        a.append(u)
                        b.append(v)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    left = members.select(group.alias("of"), "key", "tree", "node", "signature", "label")
    return materialise(wanted.groupBy("group").cogroup(left.groupBy("of")).applyInArrow(check, "a long, b long"), "links")


def likely(pairs: DataFrame, signatures: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b, key) those whose estimate is ``least`` or more."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                passed = agreement(signature_matrix(part.column(3)), signature_matrix(part.column(4))) >= least
                yield part.select(["a", "b", "key"]).filter(pa.array(passed))

    side = lambda c: signatures.select(F.col("node").alias(c), F.col("signature").alias(f"of_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "key", "of_a", "of_b").mapInArrow(run, "a long, b long, key long")


def confirmed(pairs: DataFrame, sizes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    Pairs that met in one tree node are confirmed together, so that a text goes where its partners go instead of
    with every pair; a group holds sets of about ``UNIT`` shingles. The pairs of a node that has more are dealt out.
    """
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "key").where("a < b")
    todo = materialise(ordered.groupBy("a", "b").agg(F.min("key").alias("key")), "pairs")
    needs = materialise(todo.select("key", F.explode(F.array("a", "b")).alias("node")).distinct().join(sizes, "node"), "needs")
    heavy = needs.groupBy("key").agg(F.sum("n").alias("weight")).where(F.col("weight") > UNIT).select("key", F.lit(True).alias("heavy"))
    todo = materialise(todo.join(heavy, "key", "left").select("a", "b", F.when(F.col("heavy"), F.xxhash64("a", "b")).otherwise(F.col("key")).alias("key")), "pairs")
    groups = max(1, (needs.agg(F.sum("n")).first()[0] or 0) // UNIT)
    group = F.pmod("key", F.lit(groups)).cast("int")
    wanted = materialise(todo.select(group.alias("group"), F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted").join(texts, "node")

    def check(own: pa.Table, some: pa.Table) -> pa.Table:
        shingler, sets = Shingler(), {}
        for node, t in zip(own["node"].to_pylist(), own["text"].to_pylist(), strict=True):
            sets.setdefault(node, []).append(shingler.set_of(t))
        a, b = some["a"].to_pylist(), some["b"].to_pylist()
        linked = [any(similar(x, y, percent) for x in sets[i] for y in sets[j]) for i, j in zip(a, b, strict=True)]
        return some.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return materialise(
        wanted.groupBy("group").cogroup(todo.select(group.alias("of"), "a", "b").groupBy("of")).applyInArrow(check, "a long, b long"), "links"
    )


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def near_duplicates(documents: DataFrame, *, percent: int = 80, id_col: str = "doc_id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``documents``.

    Documents are linked whose sets of five-word shingles (A-Z lower-cased; a shorter text is one shingle) have a
    Jaccard similarity of ``percent`` / 100 or more; ``component_id`` is the smallest id reachable over links.
    Null or empty text and text without words: no shingle, linked with nothing. Rows that share an id are one
    document, linked as any of its texts is. Rows of null id are linked with nothing, their component is null
    and they are kept. An empty table gives no rows. Other columns are ignored.

    Equal sets are one set from the start, whatever their number. A pair at the threshold is lost with a chance of
    2 * MISSED (8e-6) at most because it meets in no node that is compared or is one component, over all levels, and
    with one of 2e-6 (at 0.8) because its estimate is too low, which no tree makes good; pairs above it are lost more
    rarely. Links are exact. Nodes of more than ``leaf`` sets first link every set to one of them, which costs one pair
    a set; nodes that this makes one component are done. The sets of the others go on to ``trees_for`` fresh trees of
    longer paths, or to tiles of ``leaf`` sets, which miss nothing, once these take no more rows than trees. As trees
    grow in number by 1 / similarity ** DEEPER a level, that is so after log(2 * sets / leaf) / log(1 / similarity **
    DEEPER) levels at most. No task holds more than nodes of ``leaf`` signatures or sets of a few UNIT shingles, besides
    single larger sets.
    """
    all_ = materialise(sketches(documents, id_col, text), "sketches")
    able = all_.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    sets = materialise(able.groupBy("digest").agg(F.min("doc_id").cast("long").alias("node"), F.first("signature").alias("signature"), F.first("n").alias("n")), "sets")
    signatures, sizes = sets.select("node", "signature"), sets.select("node", "n")
    members = crowded(paths(signatures, percent, 0))
    wanted = members.select("node").distinct()
    source = documents.select(F.col(id_col).cast("long").alias("node"), F.col(text).alias("text"))
    texts = materialise(source.join(wanted, "node", "left_semi"), "texts")

    least, sure = percent / 100 - MARGIN, min(percent / 100 + SURE, 0.97)
    links = None
    small = members.where(F.col("size") <= leaf)
    level, once = 0, True
    large = members.where(F.col("size") > leaf)
    while large.limit(1).count():
        once = False
        centre = materialise(large.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key").alias("mix"), "node")).alias("m")).select("key", F.col("m.node").alias("centre")), "centres")
        part = F.xxhash64("key", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / 500)))
        stars = large.join(centre, "key").where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"), part.alias("key"))
        found = confirmed(likely(stars, signatures, least), sizes, texts, percent)
        links = found if links is None else links.unionByName(found)
        labelled = large.join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = materialise(labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key"), "mixed")
        rest = materialise(signatures.join(large.join(mixed, "key", "left_semi").select("node").distinct(), "node"), "crowd")
        level += 1
        blocks = ceil(2 * rest.count() / leaf)
        if not blocks:
            break
        if blocks <= trees_for(percent, level):
            small = small.unionByName(crowded(tiles(rest, blocks)))
            break
        grown = crowded(paths(rest, percent, level))
        small = small.unionByName(grown.where(F.col("size") <= leaf))
        large = grown.where(F.col("size") > leaf)

    nodes = materialise(small.join(sets, "node").select("key", "tree", "node", "n", "size", "signature"), "leaves")
    found = confirmed(compared(nodes, least, sure), sizes, texts, percent)
    links = found if links is None else links.unionByName(found)
    first = components(links)
    again = nodes.where(F.col("size") > FEW).join(first, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = materialise(again.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key"), "mixed")
    links = links.unionByName(linked_within(materialise(again.join(mixed, "key", "left_semi"), "mixed-leaves"), texts, least, percent, once))
    final = components(links.unionByName(linked_by_id(able, sets)))

    named = materialise(sets.join(final, "node", "left").select("digest", F.coalesce("label", "node").alias("component")), "set-components")
    by_id = all_.join(named, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", F.col("doc_id").cast("long")).alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return by_id.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def linked_by_id(able: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) edges between the nodes of the sets that an id has, where it has several: its smallest and each other one."""
    several = materialise(able.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id"), "ids-of-sets")
    held = materialise(able.join(several, "doc_id", "left_semi").join(sets.select("digest", "node"), "digest").select("doc_id", "node").distinct(), "sets-of-ids")
    least = materialise(held.groupBy("doc_id").agg(F.min("node").alias("a")), "least-sets")
    return held.join(least, "doc_id").where("a < node").select("a", F.col("node").alias("b"))


def keep_one(documents: DataFrame, *, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``documents`` without those whose component has a smaller id, all their columns as they are.

    Rows of null id and rows without words stay, rows that share an id stay or go together, an empty table stays empty.
    """
    gone = materialise(near_duplicates(documents, percent=percent, id_col=id_col, text=text).where(~F.col("kept")).select(F.col("doc_id").alias(id_col)).distinct(), "near-copies")
    return documents.join(gone, id_col, "left_anti").select(*documents.columns)
