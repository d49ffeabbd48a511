"""Traversals over a graph whose links fit every worker: nodes as numbers, links as arrays, no shuffle of what is reached.

The links are handed whole to the workers, each of which searches from its share of the seeds. ``compact`` gives
None for graphs beyond its bounds; those are searched by joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.session import Scratch

#: Most links, nodes and bytes of their names that are handed to each worker; most entries of all balls together that a worker keeps; rows and links handled at once.
LINKS, NODES, NAME_BYTES, BALLS = 1 << 23, 1 << 21, 1 << 27, 1 << 25
ROWS, STEP = 1 << 17, 1 << 22
#: Fixed value: neighbours with as many neighbours of their own are counted once for all seeds that share them.
HUB = 256


class Graph(NamedTuple):
    """names: in byte order, a node's number is its place; src, dst: numbers; label: place in labels; extra: columns by node."""

    names: pa.Array
    src: np.ndarray
    dst: np.ndarray
    label: np.ndarray
    labels: list[str]
    extra: dict[str, pa.Array]


def compact(links: DataFrame, label: str | None = None, nodes: DataFrame | None = None) -> Graph | None:
    """The graph of saved distinct links (src, dst and a label), with the columns of nodes (name, ...) by node.

    None beyond the bounds, with nulls in links, names that share a hash, or names that nodes have twice.
    """
    columns = ["src", "dst", *([label] if label else [])]
    n, nulls = links.agg(F.count("*"), F.count_if(F.expr(" or ".join(f"{c} is null" for c in columns)))).first()
    if n > LINKS or nulls:
        return None
    ends = links.select(F.col("src").alias("name")).union(links.select("dst")).distinct()
    count, size = ends.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("name")), F.lit(0))).first()
    if count > NODES or size > NAME_BYTES:
        return None
    known = (ends if nodes is None else ends.join(nodes, "name", "left")).withColumn("hash", F.xxhash64("name")).toArrow()
    known = known.take(pc.sort_indices(known["name"]))
    hashes = known["hash"].to_numpy()
    order = np.argsort(hashes, kind="stable")
    places = hashes[order]
    if len(known) != count or (places[1:] == places[:-1]).any():
        return None
    rows = links.select(F.xxhash64("src").alias("src"), F.xxhash64("dst").alias("dst"), *([label] if label else [])).toArrow()
    at = [order[np.searchsorted(places, rows[c].to_numpy())].astype(np.int32) for c in ("src", "dst")]
    codes, labels = np.zeros(0, np.int32), []
    if label:
        coded = rows[label].combine_chunks().dictionary_encode()
        codes, labels = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary.to_pylist()
    return Graph(known["name"].combine_chunks(), *at, codes, labels, {c: known[c].combine_chunks() for c in known.column_names if c not in ("name", "hash")})


def by_source(n: int, src: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where the links of each node begin and end, and the values of the links in that order."""
    order = np.lexsort((*values[::-1], src))
    return np.concatenate(([0], np.cumsum(np.bincount(src, minlength=n)))), *(v[order] for v in values)


def both_ways(g: Graph) -> tuple[np.ndarray, np.ndarray]:
    """Distinct neighbours in either direction, sorted, without the node itself."""
    n, apart = len(g.names), g.src != g.dst
    a, b = g.src[apart].astype(np.int64), g.dst[apart].astype(np.int64)
    pairs = np.unique(np.concatenate((a * n + b, b * n + a)))
    return by_source(n, pairs // max(n, 1), (pairs % max(n, 1)).astype(np.int32))


def places(ptr: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all links of the rows, one row after the other, and how many each has."""
    lens = ptr[rows + 1] - ptr[rows]
    return np.repeat(ptr[rows] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum()), lens


def _tasks(links: DataFrame, handed: object, work, schema: str, weights: np.ndarray) -> DataFrame:
    """Rows that ``work`` (what was handed, first and last seed) gives for shares of the seeds of like weight."""
    spark = links.sparkSession
    sums = np.cumsum(weights)
    tasks = max(1, min(8 * spark.sparkContext.defaultParallelism, len(weights)))
    cuts = [0, *np.searchsorted(sums, (sums[-1] if len(sums) else 0) * np.arange(1, tasks) / tasks).tolist(), len(weights)]
    shared = spark.sparkContext.broadcast(handed)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield from work(shared.value, cuts[k], cuts[k + 1])

    return spark.range(0, tasks, 1, tasks).mapInArrow(share, schema)


# --- what two balls share ---

_BALLS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _balls(ptr: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All balls of two steps, from closed neighbourhoods: where each begins, and its nodes, sorted."""
    n, parts, sizes = len(ptr) - 1, [], []
    reach = np.concatenate(([0], np.cumsum(np.diff(ptr)[near])))[ptr]
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(reach, reach[at] + STEP, "right")) - 1)
        first = near[ptr[at] : ptr[to]]
        where, lens = places(ptr, first)
        seed = np.repeat(np.repeat(np.arange(to - at), np.diff(ptr[at : to + 1])), lens)
        pairs = np.unique(seed * n + near[where])
        parts.append((pairs % n).astype(np.int32))
        sizes.append(np.bincount(pairs // n, minlength=to - at))
        at = to
    return np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), np.concatenate(parts)


def _shared(handed, begin: int, end: int) -> Iterator[pa.RecordBatch]:
    ident, names, ptr, near = handed
    if ident not in _BALLS:
        _BALLS.clear()
        _BALLS[ident] = _balls(ptr, near)
    bounds, ball = _BALLS[ident]
    parts, held = [], 0
    for a in range(begin, end):
        others = ball[places(bounds, ball[bounds[a] : bounds[a + 1]])[0]]
        others = np.sort(others[others > a])
        if len(others):
            first = np.concatenate(([0], np.flatnonzero(others[1:] != others[:-1]) + 1, [len(others)]))
            parts.append((np.full(len(first) - 1, a, np.int32), others[first[:-1]], np.diff(first)))
            held += len(first) - 1
        if parts and (held >= ROWS or a == end - 1):
            seed, other, shared = (np.concatenate(x) for x in zip(*parts))
            yield from _batches([names.take(pa.array(seed)), names.take(pa.array(other)), pa.array(shared)], ["seed", "other", "n_shared"])
            parts, held = [], 0
    if parts:
        seed, other, shared = (np.concatenate(x) for x in zip(*parts))
        yield from _batches([names.take(pa.array(seed)), names.take(pa.array(other)), pa.array(shared)], ["seed", "other", "n_shared"])


def _batches(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, names)
    for at in range(0, whole.num_rows, ROWS):
        yield whole.slice(at, ROWS)


def shared_counts(edges: DataFrame) -> DataFrame | None:
    """seed, other, n_shared: how many nodes the two-step balls of each two ends share, over edges either way."""
    scratch = Scratch(edges.sparkSession, "shared")
    links = scratch.save(edges.select("src", "dst").distinct(), "links")
    if (g := compact(links)) is None:
        return None
    n = len(g.names)
    ptr, near = both_ways(g)
    own = np.arange(n, dtype=np.int32)
    ptr, near = by_source(n, np.concatenate((np.repeat(own, np.diff(ptr)), own)), np.concatenate((near, own)))
    size = np.diff(ptr)
    reach = np.add.reduceat(size[near], ptr[:-1]) if n else size
    if reach.sum() > BALLS:
        return None
    weights = np.add.reduceat(reach[near], ptr[:-1]) if n else size
    return _tasks(links, (scratch.root, g.names, ptr, near), _shared, "seed string, other string, n_shared bigint", weights * 4 + 1000)


# --- nodes and repositories of two-step blasts ---

_BLAST = ["seed", *(f"{what}{k}" for k in (1, 2) for what in ("rows", "known", "placed", "repos")), "repos"]


def _blast(handed, begin: int, end: int) -> Iterator[pa.RecordBatch]:
    """Seeds are taken in the order of their neighbours, the largest first, so that what the largest reach is counted once for all seeds in a row that share them."""
    names, ptr, near, number, known, repo, order, n_repos = handed
    n, hubs = len(ptr) - 1, int((np.diff(ptr) >= HUB).sum())  # nodes are numbered by falling size here
    seeds = order[begin:end]
    paths = {s: tuple(x[: np.searchsorted(x, hubs)].tolist()) for s in seeds.tolist() for x in [near[ptr[s] : ptr[s + 1]]]}
    mask, in_repo = np.zeros(n, bool), np.zeros(n_repos, np.int64)
    stack: list[tuple[int, np.ndarray, np.ndarray]] = []
    rows = []

    def tally(nodes: np.ndarray) -> np.ndarray:
        return np.array([len(nodes), known[nodes].sum(), (repo[nodes] >= 0).sum()])

    total = np.zeros(3, np.int64)
    for s in sorted(paths, key=paths.__getitem__):
        path = paths[s]
        same = 0
        while same < len(stack) and same < len(path) and stack[same][0] == path[same]:
            same += 1
        while len(stack) > same:
            _, nodes, count = stack.pop()
            mask[nodes] = False
            total -= count
            in_repo -= np.bincount(repo[nodes][repo[nodes] >= 0], minlength=n_repos)
        for h in path[same:]:
            nodes = np.append(near[ptr[h] : ptr[h + 1]], h)
            nodes = nodes[~mask[nodes]]
            mask[nodes] = True
            stack.append((h, nodes, tally(nodes)))
            total += stack[-1][2]
            in_repo += np.bincount(repo[nodes][repo[nodes] >= 0], minlength=n_repos)
        own = near[ptr[s] : ptr[s + 1]]
        if not len(own):
            continue
        few = own[len(path) :]
        more = np.append(near[places(ptr, few)[0]], few)
        more = np.unique(more[~mask[more]])
        centre = np.append(own, s)
        at, place = np.unique(np.concatenate((repo[more], repo[centre])), return_inverse=True)
        old = np.where(at >= 0, in_repo[at], 0)
        after = old + np.bincount(place[: len(more)], minlength=len(at))
        beyond = after - np.bincount(place[len(more) :], minlength=len(at))
        near_by = np.bincount(place[len(more) : -1], minlength=len(at))
        after[place[-1]] -= 1
        placed = at >= 0
        rest = int((in_repo > 0).sum() - (old > 0).sum())
        one = tally(own)
        two = total + tally(more) - tally(centre)
        rows.append((s, *one, int((near_by[placed] > 0).sum()), *two, rest + int((beyond[placed] > 0).sum()), rest + int((after[placed] > 0).sum())))
    if rows:
        columns = np.array(rows, np.int64).T
        yield from _batches([names.take(pa.array(number[columns[0]])), *map(pa.array, columns[1:])], _BLAST)


def blast(edges: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """Counts of what each end reaches in one and in two steps either way, itself left out; ends that reach nothing have no row.

    nodes: id, repo. Columns: seed, and for each step rows, known (those in nodes), placed (with a repository) and repos; repos of both.
    """
    scratch = Scratch(edges.sparkSession, "blast")
    links = scratch.save(edges.select("src", "dst").distinct(), "links")
    g = compact(links, nodes=nodes.select(F.col("id").alias("name"), "repo", F.lit(True).alias("known")))
    if g is None:
        return None
    n = len(g.names)
    ptr, near = both_ways(g)
    number = np.argsort(-np.diff(ptr), kind="stable")
    rank = np.empty(n, np.int32)
    rank[number] = np.arange(n, dtype=np.int32)
    ptr, near = by_source(n, rank[np.repeat(np.arange(n), np.diff(ptr))], rank[near])
    known = g.extra["known"].is_valid().to_numpy(zero_copy_only=False)[number]
    coded = g.extra["repo"].dictionary_encode()
    repo = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)[number]
    size = np.diff(ptr)
    first, second = (np.where(size > k, np.append(near, [n] * 2)[ptr[:-1] + k], n) for k in (0, 1))
    order = np.lexsort((second, first))
    light = np.concatenate(([0], np.cumsum(np.where(size < HUB, size, 0)[near])))
    weights = (light[ptr[1:]] - light[ptr[:-1]] + size)[order] + 2000
    handed = (g.names, ptr, near, number.astype(np.int32), known, repo, order, max(1, len(coded.dictionary)))
    return _tasks(links, handed, _blast, "seed string, " + ", ".join(f"{c} bigint" for c in _BLAST[1:]), weights)


# --- consequences ---


def _consequences(handed, begin: int, end: int) -> Iterator[pa.RecordBatch]:
    names, labels, n_hard, every, later, seeds, depth = handed
    n, m = len(names), max(1, len(labels))
    via, tier = pa.array(labels, pa.string()), pa.array(["hard", "soft"])
    shares = [(at, min(at + 256, end)) for at in range(begin, end, 256)][::-1]
    while shares:
        at, to = shares.pop()
        own = seeds[at:to].astype(np.int64)
        seen = front = np.arange(to - at) * n + own
        found = []
        for k in range(1, depth + 1):
            ptr, dst, code = every if k == 1 else later
            lens = ptr[front % n + 1] - ptr[front % n]
            if lens.sum() > STEP and to - at > 1:
                found, half = None, (at + to) // 2
                shares += [(half, to), (at, half)]
                break
            where, lens = places(ptr, front % n)
            best = np.sort((np.repeat(front // n, lens) * n + dst[where]) * m + code[where])
            key = best // m
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            key, best = key[first], best[first] % m
            place = np.minimum(np.searchsorted(seen, key), len(seen) - 1)
            fresh = seen[place] != key
            front, best = key[fresh], best[fresh]
            seen = np.sort(np.concatenate((seen, front)))
            found.append((front, best, np.full(len(front), k, np.int32)))
        if found:
            key, best, steps = (np.concatenate(x) for x in zip(*found))
            for a in range(0, len(key), ROWS):
                x, b = key[a : a + ROWS], best[a : a + ROWS]
                columns = [names.take(pa.array(own[x // n])), names.take(pa.array(x % n)), pa.array(steps[a : a + ROWS]), tier.take(pa.array((b >= n_hard).astype(np.int8))), via.take(pa.array(b))]
                yield pa.RecordBatch.from_arrays(columns, ["seed", "node", "depth", "tier", "via"])


def consequences(links: DataFrame, seeds: DataFrame, depth: int, hard: tuple[str, ...], soft: tuple[str, ...]) -> DataFrame | None:
    """As ``architecture.consequences``, over saved distinct links src, dst, rel_type. seeds: seed, each once."""
    g = compact(links, "rel_type", seeds.select(F.col("seed").alias("name"), F.lit(True).alias("is_seed")))
    if g is None:
        return None
    n = len(g.names)
    ranked = sorted(g.labels, key=lambda x: (x not in hard, x.encode()))
    code = np.array([ranked.index(x) for x in g.labels], np.int32)[g.label] if g.labels else g.label
    goes_on = np.isin(code, [k for k, x in enumerate(ranked) if x in hard or x in soft])
    every, later = by_source(n, g.src, g.dst, code), by_source(n, g.src[goes_on], g.dst[goes_on], code[goes_on])
    at = np.flatnonzero(g.extra["is_seed"].is_valid().to_numpy(zero_copy_only=False)).astype(np.int32)
    step = np.concatenate(([0], np.cumsum(np.diff(later[0])[every[1]])))
    weights = (step[every[0][1:]] - step[every[0][:-1]] + np.diff(every[0]))[at] + 50
    return _tasks(links, (g.names, ranked, sum(x in hard for x in ranked), every, later, at, depth), _consequences, "seed string, node string, depth int, tier string, via string", weights)
