"""Parent–child links to full hierarchies: peeling, Euler tours and parallel list ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.operators.skew import lookup_join
from graphlens.session import Scratch, ship, shuffle_partitions

#: Shares into which the children of one parent are dealt while siblings are put in order.
SIBLING_SHARES = 64
#: Rows, of some 40 bytes, of a rest that one task solves by itself once rounds have made it as small.
SMALL = 1 << 20


def numbered_tree(links: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``names`` (n, node_id) and ``tree`` (n, up) of links (parent, child); up is null at roots."""
    links = links.filter("parent is not null and child is not null").groupBy("child").agg(F.min("parent").alias("parent"))
    links = scratch.save(links, "links")
    ids = links.select(F.col("child").alias("node_id")).union(links.select("parent")).distinct()
    names = scratch.save(ids.withColumn("n", F.monotonically_increasing_id()), "names")
    child, parent = names.toDF("child", "n"), names.toDF("parent", "up")
    linked = lookup_join(links, parent, "parent").join(child, "child").select("n", "up")
    return names, scratch.save(names.select("n").join(linked, "n", "left"), "tree")


def _in_one_task(df: DataFrame, solve, schema: str) -> DataFrame:
    """``solve`` on all rows of a table of at most ``SMALL`` rows at once, a pandas DataFrame each way."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if parts := [b for b in batches if len(b)]:
            yield solve(pd.concat(parts, ignore_index=True))

    return df.coalesce(1).mapInPandas(run, schema)


def _cycles_of(rest: pd.DataFrame) -> pd.DataFrame:
    """Doubles the parent pointers until no doubling takes a node away from those pointed at."""
    n = np.sort(rest["n"].to_numpy())
    # A node without a row of its own is the end of what points at it.
    at = np.full(len(n) + 1, len(n))
    where = np.searchsorted(n, rest["up"].to_numpy())
    known = (where < len(n)) & (n[np.minimum(where, len(n) - 1)] == rest["up"].to_numpy())
    at[np.searchsorted(n, rest["n"].to_numpy())] = np.where(known, where, len(n))
    size, image = -1, np.unique(at[:-1])
    while len(image) != size:
        size, at = len(image), at[at]
        image = np.unique(at[:-1])
    return pd.DataFrame({"n": n[image[image < len(n)]]})


def cycle_nodes(tree: DataFrame, scratch: Scratch, peel_rounds: int = 4, small: int | None = None) -> DataFrame:
    """The nodes (n) that lie on a cycle, a self-link included.

    Leaves are peeled off ``peel_rounds`` times at most: that leaves cycles and what stands above
    deep branches. There the parent pointer is doubled: after m steps only nodes that have
    descendants m levels below are still pointed at. The levels have no gaps, so once a doubling takes
    nothing away only cycles are left. Rounds: the logarithm of the longest way to a root or cycle. Once at most
    ``small`` rows are left, one task goes on alone. A node to which all point is a hot key: it is looked up apart.
    """
    small = SMALL if small is None else small
    rest = tree.filter("up is not null")
    left = rest.count()
    for _ in range(peel_rounds):
        if left <= small:
            break
        peeled = scratch.save(rest.join(rest.select(F.col("up").alias("n")).distinct(), "n", "left_semi"), "peeled")
        before, left = left, peeled.count()
        scratch.drop(rest)
        rest = peeled
        if left == before:
            break
    if left <= small:
        return _in_one_task(rest, _cycles_of, "n long")
    jump, size = rest, None
    while True:
        image = jump.select("up").distinct().count()
        if image in (0, size):
            break
        size = image
        ahead = jump.select(F.col("n").alias("up"), F.col("up").alias("next"))
        doubled = scratch.save(lookup_join(jump, ahead, "up").select("n", F.col("next").alias("up")), "doubled")
        scratch.drop(jump)
        jump = doubled
    return jump.select(F.col("up").alias("n")).distinct()


def euler_list(forest: DataFrame) -> DataFrame:
    """The Euler tours of a forest (n, up, bad) as linked lists: e, next, cnt, bal, tail.

    Element 2n enters node n and 2n+1 leaves it. Siblings are chained in shares of their parent,
    then the shares in order, so that a parent of very many children is no single sort.
    """
    share = F.pmod(F.xxhash64("n"), F.lit(SIBLING_SHARES)).cast("int")
    kids = forest.filter("up is not null").select("n", "up", share.alias("share"))
    sibling = kids.withColumn("sibling", F.lead("n").over(Window.partitionBy("up", "share").orderBy("n")))
    shares = kids.groupBy("up", "share").agg(F.min("n").alias("head"))
    order = Window.partitionBy("up").orderBy("share")
    shares = shares.select("up", "share", F.lead("head").over(order).alias("next_head"), F.row_number().over(order).alias("at"), "head")
    after = sibling.join(shares.select("up", "share", "next_head"), ["up", "share"])
    after = after.select("n", F.coalesce(F.col("sibling") * 2, F.col("next_head") * 2, F.col("up") * 2 + 1).alias("next"))
    first = shares.filter("at = 1").select(F.col("up").alias("n"), (F.col("head") * 2).alias("next"))
    enter = forest.select("n").join(first, "n", "left").select((F.col("n") * 2).alias("e"), F.coalesce("next", F.col("n") * 2 + 1).alias("next"), F.lit(1).alias("bal"), F.lit(None).cast("long").alias("tail"))
    # The last element of a tour carries the mark of its root.
    mark = F.when(F.col("up").isNull(), F.when(F.col("bad"), -1 - F.col("n")).otherwise(F.col("n")))
    leave = forest.join(after, "n", "left").select((F.col("n") * 2 + 1).alias("e"), "next", F.lit(-1).alias("bal"), mark.alias("tail"))
    return enter.unionByName(leave).select("e", "next", F.lit(1).cast("long").alias("cnt"), F.col("bal").cast("long").alias("bal"), "tail")


def _ranks_of(rest: pd.DataFrame) -> pd.DataFrame:
    """Pointer jumping over whole arrays; ``next`` is null at the ends."""
    rest = rest.sort_values("e", ignore_index=True)
    e = rest["e"].to_numpy()
    nxt = rest["next"].to_numpy(dtype=float, na_value=np.nan)
    at = np.where(np.isnan(nxt), -1, np.searchsorted(e, np.nan_to_num(nxt, nan=e[0]).astype(np.int64)))
    cnt, bal, end = rest["cnt"].to_numpy(np.int64), rest["bal"].to_numpy(np.int64), np.where(at < 0, np.arange(len(e)), -1)
    while (on := np.flatnonzero(at >= 0)).size:
        to = at[on]
        add, more, ends, onward = cnt[to], bal[to], end[to], at[to]
        cnt[on] += add
        bal[on] += more
        end[on] = ends
        at[on] = onward
    tail = rest["tail"].to_numpy(dtype=float, na_value=np.nan)[end]
    return pd.DataFrame({"e": e, "cnt": cnt, "bal": bal, "tail": tail.astype(np.int64)})


def rank_list(elements: DataFrame, scratch: Scratch, small: int | None = None) -> DataFrame:
    """List ranking: e, and cnt, bal and tail of everything from an element to its end.

    elements: e, next (null at an end), cnt, bal, tail (known at ends, which all have one).

    While more than ``small`` elements are left, lists are contracted: an element whose random mark is less than those
    of both its neighbours, about every third one, is bridged by the one before it and put aside. One task ranks what is left by pointer jumping; then the
    elements put aside come back in reverse order, each by one look at its successor. No neighbours go at once, keys are
    unique on both sides of all joins, and what is read shrinks by a third each round, so that all rounds together cost some three times the first.
    Of very many short lists only ends are left at last: then few go, and those rests are jumped over in a few rounds.
    """
    small = SMALL if small is None else small
    active = scratch.save(elements.select("e", "next", "cnt", "bal", "tail"), "active")
    aside: list[DataFrame] = []
    size, before = active.count(), None
    while size > small and (before is None or size < 0.95 * before):
        mark = lambda c: F.xxhash64(F.col(c), F.lit(len(aside)))
        b = active.select(F.col("e").alias("next"), F.col("next").alias("n1"), F.col("cnt").alias("c1"), F.col("bal").alias("b1"))
        goes = F.coalesce(F.col("n1").isNotNull() & (mark("next") < mark("e")) & (mark("next") < mark("n1")), F.lit(False))
        pairs = scratch.save(active.join(b, "next", "left").withColumn("goes", goes), "pairs")
        gone = scratch.save(pairs.filter("goes").select(F.col("next").alias("e"), F.col("n1").alias("next"), F.col("c1").alias("cnt"), F.col("b1").alias("bal")), "aside")
        aside.append(gone)
        bridged = pairs.select("e", F.when(F.col("goes"), F.col("n1")).otherwise(F.col("next")).alias("next"), F.when(F.col("goes"), F.col("cnt") + F.col("c1")).otherwise(F.col("cnt")).alias("cnt"), F.when(F.col("goes"), F.col("bal") + F.col("b1")).otherwise(F.col("bal")).alias("bal"), "tail")
        kept = scratch.save(bridged.join(gone.select("e"), "e", "left_anti"), "active")
        scratch.drop(active, pairs)
        active = kept
        size, before = active.count(), size
    if size <= small:
        ranks = scratch.save(_in_one_task(active, _ranks_of, "e long, cnt long, bal long, tail long"), "ranks")
    else:
        while active.filter("next is not null").limit(1).count():
            b = active.select(F.col("e").alias("next"), F.col("next").alias("n1"), F.col("cnt").alias("c1"), F.col("bal").alias("b1"), F.col("tail").alias("t1"))
            zero = lambda c: F.coalesce(c, F.lit(0))
            active = scratch.save(active.join(b, "next", "left").select("e", F.col("n1").alias("next"), (F.col("cnt") + zero("c1")).alias("cnt"), (F.col("bal") + zero("b1")).alias("bal"), F.coalesce("tail", "t1").alias("tail")), "jumped")
        ranks = active.select("e", "cnt", "bal", "tail")
    for gone in reversed(aside):
        after = ranks.select(F.col("e").alias("next"), F.col("cnt").alias("c1"), F.col("bal").alias("b1"), F.col("tail"))
        back = gone.join(after, "next").select("e", (F.col("cnt") + F.col("c1")).alias("cnt"), (F.col("bal") + F.col("b1")).alias("bal"), "tail")
        ranks = ranks.unionByName(scratch.save(back, "back"))
    return ranks


def tour_paths(separator: str):
    """Walks tours in order with a stack of open nodes; rows that seed a chunk are not given out."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, stack = None, []
        for pdf in batches:
            rows = []
            for tail, chunk, enter, leave, node, depth, seed in zip(pdf["tail"], pdf["chunk"], pdf["enter"], pdf["leave"], pdf["node_id"], pdf["depth"], pdf["seed"]):
                if (tail, chunk) != at:
                    at, stack = (tail, chunk), []
                while stack and stack[-1][0] < enter:
                    stack.pop()
                path = f"{stack[-1][1]}{separator}{node}" if stack else node
                root = stack[0][1] if stack else node
                stack.append((leave, path))
                if not seed:
                    rows.append((node, root, depth, path, enter, leave))
            yield pd.DataFrame(rows, columns=["node_id", "root_id", "depth", "node_path", "enter", "leave"])

    return walk


def hierarchies(links: DataFrame, separator: str = " > ", peel_rounds: int = 4, chunk: int = 50_000, small: int | None = None) -> DataFrame:
    """Root, depth and full path of every node of parent–child links, or that a cycle holds it.

    links: ``parent``, ``child``; further columns do no harm. Result: node_id, root_id, depth,
    node_path, state (ok, cycle, under_cycle), enter, leave. Entry and exit count back from the end of
    the tree's tour: x is an ancestor of y if both have the same root and x.enter < y.enter and
    y.leave < x.leave. Nodes of a cycle or below one have depth -1, '' as root and path, and no interval.

    Defined results: links with a null end are no links; repeated links count once; of several
    parents of a node the least id counts; a link of a node to itself is a cycle; no links give no rows.

    Paths come from one walk over the tours in chunks of positions. The nodes still open where a
    chunk begins are those whose interval spans its start, so a tree of any size is shared out.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "hierarchy")
    names, tree = numbered_tree(links, scratch)
    cycles = scratch.save(cycle_nodes(tree, scratch, peel_rounds, small), "cycles")
    mark = cycles.select(F.col("n").alias("up"), F.lit(True).alias("bad"))
    forest = lookup_join(tree.join(cycles, "n", "left_anti"), mark, "up", "left")
    forest = forest.select("n", F.when(F.col("bad").isNull(), F.col("up")).alias("up"), F.coalesce("bad", F.lit(False)).alias("bad"))
    forest = scratch.save(forest, "forest")
    ranks = rank_list(euler_list(forest), scratch, small)
    enters = ranks.filter("e % 2 = 0").select(F.expr("shiftright(e, 1)").alias("n"), (-F.col("cnt")).alias("enter"), (-F.col("bal")).cast("int").alias("depth"), "tail")
    leaves = ranks.filter("e % 2 <> 0").select(F.expr("shiftright(e, 1)").alias("n"), (-F.col("cnt")).alias("leave"))
    spans = scratch.save(enters.join(leaves, "n").join(names, "n"), "spans")
    good = spans.filter("tail >= 0")
    first, last = F.floor(F.col("enter") / chunk), F.floor(F.col("leave") / chunk)
    own = good.select("tail", first.alias("chunk"), "enter", "leave", "node_id", "depth", F.lit(False).alias("seed"))
    seeds = good.filter(first < last).select("tail", F.explode(F.sequence(first + 1, last)).alias("chunk"), "enter", "leave", "node_id", "depth", F.lit(True).alias("seed"))
    ordered = own.unionByName(seeds).repartition(shuffle_partitions(spark), "tail", "chunk").sortWithinPartitions("tail", "chunk", "enter")
    ok = ordered.mapInPandas(tour_paths(separator), "node_id string, root_id string, depth int, node_path string, enter long, leave long")
    ok = ok.select("node_id", "root_id", "depth", "node_path", F.lit("ok").alias("state"), "enter", "leave")
    lost = cycles.join(names, "n").select("node_id", F.lit("cycle").alias("state")).unionByName(spans.filter("tail < 0").select("node_id", F.lit("under_cycle").alias("state")))
    lost = lost.select("node_id", F.lit("").alias("root_id"), F.lit(-1).alias("depth"), F.lit("").alias("node_path"), "state", F.lit(None).cast("long").alias("enter"), F.lit(None).cast("long").alias("leave"))
    return ok.unionByName(lost)


def descendants(nodes: DataFrame, ancestor_id: str) -> DataFrame:
    """All descendants of one node, by interval, from a result of ``hierarchies``."""
    top = nodes.filter(F.col("node_id") == ancestor_id).select(F.col("root_id"), F.col("enter").alias("_enter"), F.col("leave").alias("_leave"))
    return nodes.join(top, "root_id").filter("enter > _enter and leave < _leave").drop("_enter", "_leave")
