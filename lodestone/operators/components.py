"""Strongly connected components of dependency graphs.

A workspace of up to ``SMALL`` edges is searched in one task. Larger ones are worked on as tables of edges between numbered symbols, in steps after each of which what is left is
written: (1) symbols without incoming or outgoing edges are taken off; (2) chains, symbols with one edge in and one out, are contracted to an edge by pointer doubling, so a
chain of n symbols takes log n rounds; a ring of such symbols is a component; (3) when neither helps, each symbol takes the greatest number that leads to it (its colour), by
edges and by the colour's own colour; a symbol of its own colour is a root, and the root's component is what leads back to it among its colour. Edges inside what is found,
and between colours, are left out, and the rest starts again. A contracted symbol is in the component of its chain's two ends if that is one, and else alone.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import Steps

#: Edges of a workspace that one task holds.
SMALL = 200_000


def searched(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """The least symbol of each symbol's component: a depth-first search that numbers symbols and holds the open ones, without recursion."""
    ahead: dict[str, list[str]] = {}
    for a, b in sorted(pairs):
        ahead.setdefault(a, []).append(b)
        ahead.setdefault(b, [])
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    held: list[str] = []
    open_: set[str] = set()
    out: dict[str, str] = {}
    for start in ahead:
        if start in number:
            continue
        way = [(start, iter(ahead[start]))]
        number[start] = low[start] = len(number)
        held.append(start)
        open_.add(start)
        while way:
            a, rest = way[-1]
            for b in rest:
                if b not in number:
                    number[b] = low[b] = len(number)
                    held.append(b)
                    open_.add(b)
                    way.append((b, iter(ahead[b])))
                    break
                if b in open_:
                    low[a] = min(low[a], number[b])
            else:
                way.pop()
                if way:
                    low[way[-1][0]] = min(low[way[-1][0]], low[a])
                if low[a] == number[a]:
                    mine = []
                    while not mine or mine[-1] != a:
                        mine.append(held.pop())
                    open_.difference_update(mine)
                    out.update(dict.fromkeys(mine, min(mine)))
    return out


def _in_tasks(edges: DataFrame) -> DataFrame:
    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        found = searched(list(zip(x["a"], x["b"], strict=True)))
        return pd.DataFrame({"workspace_id": key[0], "symbol": list(found), "component": list(found.values())})

    return edges.groupBy("workspace_id").applyInPandas(run, "workspace_id string, symbol string, component string")


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges less those from symbols that nothing leads to, and to symbols that lead nowhere."""
    return edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")


def contracted(steps: Steps, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """edges with each chain as one edge, the chains' symbols (v, source, target: the chain's ends), and rings of such symbols (v, c: the component)."""
    ins, outs = (edges.groupBy(F.col(x).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.first(y).alias(z)).filter("n = 1").drop("n") for x, y, z in (("b", "a", "source"), ("a", "b", "target")))
    inner = steps.keep(ins.join(outs, "v").filter("source != v AND target != v"))
    n = inner.count()
    if not n:
        return edges, inner, inner.select("v", F.col("v").alias("c"))
    chain, rounds = inner.withColumn("low", F.col("v")), 0
    while 1 << rounds <= 2 * n:
        up = chain.select(F.col("v").alias("target"), F.col("target").alias("t"), F.col("low").alias("l"))
        down = chain.select(F.col("v").alias("source"), F.col("source").alias("s"))
        moved = chain.join(up, "target", "left").join(down, "source", "left")
        chain = steps.keep(moved.select("v", F.coalesce("s", "source").alias("source"), F.coalesce("t", "target").alias("target"), F.least("low", F.coalesce("l", "low")).alias("low"), (F.col("s").isNotNull() | F.col("t").isNotNull()).alias("open")))
        rounds += 1
        if chain.filter("open").isEmpty():
            break
        chain = chain.drop("open")
    own = inner.select(F.col("v").alias("target"))
    rings = steps.keep(chain.join(own, "target", "left_semi").select("v", F.col("low").alias("c")))
    chain = chain.join(rings, "v", "left_anti").select("v", "source", "target")
    ends = inner.select("v")
    plain = edges.join(ends.withColumnRenamed("v", "a"), "a", "left_anti").join(ends.withColumnRenamed("v", "b"), "b", "left_anti").select("a", "b")
    return steps.keep(plain.unionByName(chain.select(F.col("source").alias("a"), F.col("target").alias("b"))).distinct()), chain, rings


def coloured(steps: Steps, edges: DataFrame) -> DataFrame:
    """v, c: the greatest number of a symbol that leads to v, or its own."""
    colour = steps.keep(edges.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("c", F.col("v")))
    while True:
        step = edges.join(colour.withColumnRenamed("v", "a"), "a").select(F.col("b").alias("v"), "c")
        up = colour.groupBy("v").agg(F.max("c").alias("c")).unionByName(step).groupBy("v").agg(F.max("c").alias("c"))
        # What leads to a symbol's colour leads to the symbol.
        jumped = up.join(up.select(F.col("v").alias("c"), F.col("c").alias("cc")), "c", "left").select("v", F.greatest("c", F.coalesce("cc", "c")).alias("c"))
        after = steps.keep(jumped.join(colour.withColumnRenamed("c", "before"), "v").select("v", "c", (F.col("c") != F.col("before")).alias("moved")))
        colour = after.select("v", "c")
        if after.filter("moved").isEmpty():
            return colour


def rooted(steps: Steps, edges: DataFrame, colour: DataFrame) -> tuple[DataFrame, DataFrame]:
    """v, c of what leads back to the root of its colour; and the edges inside a colour."""
    inside = steps.keep(edges.join(colour.withColumnsRenamed({"v": "a", "c": "ca"}), "a").join(colour.withColumnsRenamed({"v": "b", "c": "cb"}), "b").filter("ca = cb").select("a", "b"))
    found = front = steps.keep(colour.filter("v = c"))
    while True:
        back = inside.join(front.withColumnRenamed("v", "b"), "b").select(F.col("a").alias("v"), "c").distinct()
        front = steps.keep(back.join(found, "v", "left_anti"))
        if front.isEmpty():
            return found, inside
        found = found.unionByName(front)


def numbered(steps: Steps, edges: DataFrame) -> DataFrame:
    """v, c of all symbols (a and b of ``edges``, numbers) on a cycle; others may be missing."""
    chains, found = [], []
    left = steps.keep(edges.filter("a != b").distinct())
    count = left.count()
    while count:
        while True:
            before = count
            left, chain, rings = contracted(steps, steps.keep(trimmed(left)))
            # An edge from a symbol to itself tells nothing more about it, but its chain's symbols are with it.
            left = left.filter("a != b")
            chains.append(chain)
            found.append(rings)
            count = left.count()
            if count == before or not count:
                break
        if not count:
            break
        done, inside = rooted(steps, left, coloured(steps, left))
        found.append(done)
        ends = done.select("v")
        left = steps.keep(inside.join(ends.withColumnRenamed("v", "a"), "a", "left_anti").join(ends.withColumnRenamed("v", "b"), "b", "left_anti").select("a", "b"))
        count = left.count()
    if not found:
        return edges.select(F.col("a").alias("v"), F.col("a").alias("c")).limit(0)
    known = found[0]
    for x in found[1:]:
        known = known.unionByName(x)
    known = steps.keep(known)
    # The last chains first: what they were cut from may hold ends of earlier ones. An end that is known nowhere is alone.
    for chain in reversed(chains):
        ends = [known.withColumnsRenamed({"v": k, "c": f"c_{k}"}) for k in ("source", "target")]
        both = chain.join(ends[0], "source", "left").join(ends[1], "target", "left")
        of = lambda k: F.coalesce(F.col(f"c_{k}"), F.col(k))
        same = both.filter(of("source") == of("target"))
        more = same.select("v", of("source").alias("c"))
        known = steps.keep(known.unionByName(more).unionByName(same.select(F.col("source").alias("v"), of("source").alias("c"))).distinct())
    return known


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """workspace_id, symbol, component (its least symbol) and size of each symbol of the edges (workspace_id, source_symbol, target_symbol)."""
    steps = Steps(edges)
    pairs = steps.keep(edges.select("workspace_id", F.col("source_symbol").alias("a"), F.col("target_symbol").alias("b")).distinct())
    sizes = pairs.groupBy("workspace_id").count()
    large = steps.keep(sizes.filter(F.col("count") > small).select("workspace_id"))
    out = _in_tasks(pairs.join(large, "workspace_id", "left_anti"))
    if not large.isEmpty():
        rows = pairs.join(large, "workspace_id", "left_semi")
        names = steps.keep(rows.select("workspace_id", F.explode(F.array("a", "b")).alias("symbol")).distinct().withColumn("v", F.monotonically_increasing_id()))
        end = lambda x: names.withColumnsRenamed({"symbol": x, "v": f"{x}_v"})
        by_number = rows.join(end("a"), ["workspace_id", "a"]).join(end("b"), ["workspace_id", "b"]).select(F.col("a_v").alias("a"), F.col("b_v").alias("b"))
        own = names.join(numbered(steps, by_number), "v", "left").select("workspace_id", "symbol", F.coalesce("c", "v").alias("c"))
        least = own.groupBy("c").agg(F.min("symbol").alias("component"))
        out = out.unionByName(own.join(least, "c").select("workspace_id", "symbol", "component"))
    out = steps.keep(out)
    sizes = out.groupBy("workspace_id", "component").agg(F.count(F.lit(1)).alias("size"))
    return steps.end(out.join(sizes, ["workspace_id", "component"]).select("workspace_id", "symbol", "component", "size"))


def on_cycles(edges: DataFrame, found: DataFrame) -> DataFrame:
    """workspace_id, component, a, b of the edges inside components: exactly those that are on a cycle."""
    of = lambda x: found.select("workspace_id", F.col("symbol").alias(x), F.col("component").alias(f"of_{x}"))
    pairs = edges.select("workspace_id", F.col("source_symbol").alias("a"), F.col("target_symbol").alias("b")).distinct()
    both: Column = F.col("of_a") == F.col("of_b")
    return pairs.join(of("a"), ["workspace_id", "a"]).join(of("b"), ["workspace_id", "b"]).filter(both).select("workspace_id", F.col("of_a").alias("component"), "a", "b")
