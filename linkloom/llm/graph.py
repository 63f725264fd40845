"""Links inside groups of any size, and the components that links form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.session import cut_lineage

EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: compare(payloads) gives the pairs of positions that are linked.
Compare = Callable[[list], list[tuple[int, int]]]


def forest(n: int, links: list[tuple[int, int]]) -> list[int]:
    """Union-find over positions; the root of each position, smallest first."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def _star_edges(compare: Compare):
    """Each block of members becomes one edge per linked member, to the smallest
    member of its tree: as many rows as members at most, never all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for block in batch.column("block"):
                rows = sorted(block.as_py(), key=lambda r: r["id"])
                roots = forest(len(rows), compare([r["payload"] for r in rows]))
                for k, r in enumerate(roots):
                    if rows[k]["id"] != rows[r]["id"]:
                        a.append(rows[k]["id"])
                        b.append(rows[r]["id"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=EDGES)

    return run


def components(edges: DataFrame, label: str) -> DataFrame:
    """``(id, root)`` for every end of an edge: root is the smallest id reachable.

    Smallest labels travel along edges and are followed (pointer jumping) until
    a round changes nothing; each round is a written table, so lost executors
    cost one round. Nothing is gathered: hubs are keys of joins that Spark splits.
    """
    both = edges.select("a", "b").where("a <> b")
    both = cut_lineage(both.union(both.select("b", "a")).distinct(), f"{label}-edges")
    roots = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
    roots = cut_lineage(roots.select("id", F.least("id", "m").alias("root")), f"{label}-roots")
    while True:
        near = (
            both.join(roots.select(F.col("id").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("root").alias("near"))
        )
        step = roots.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = step.select(F.col("id").alias("root"), F.col("root").alias("top"))
        new = cut_lineage(
            step.join(up, "root").select("id", F.col("top").alias("root"), (F.col("top") != F.col("old")).alias("moved")),
            f"{label}-roots",
        )
        roots = new.select("id", "root")
        if new.where("moved").isEmpty():
            return roots


def _blocks(rows: DataFrame, payloads: DataFrame, keys: list[str]) -> DataFrame:
    return (
        rows.join(payloads, "id")
        .groupBy(*keys)
        .agg(F.collect_list(F.struct("id", "payload")).alias("block"))
        .select("block")
    )


def link_within_groups(members: DataFrame, payloads: DataFrame, compare: Compare, size: int, label: str) -> DataFrame:
    """Edges so that members of one group which ``compare`` links, directly or
    through others of the group, are connected.

    ``members``: distinct ``(grp, id)``; ``payloads``: ``(id, payload)``. A group
    is cut into blocks of about ``size`` members, and its smallest member joins
    every block. What a block leaves unconnected to that member meets all other
    blocks in a second pass; two blocks of connected members never meet. So a
    group of copies costs one visit a member, and no link is lost.
    """
    # Written, so that its join has two shuffled sides: Spark splits a hot group then.
    stats = members.groupBy("grp").agg(F.count("*").alias("n"), F.min("id").alias("c")).where("n > 1")
    stats = cut_lineage(stats, f"{label}-stats")
    many = cut_lineage(members.join(stats, "grp"), f"{label}-members")

    def cut(n):
        return F.ceil(n / F.lit(size)).cast("int")

    def own(n):
        return F.pmod(F.xxhash64("id"), cut(n)).cast("int")

    every = F.sequence(F.lit(0), cut(F.col("n")) - 1)
    placed = many.select(
        "grp", "id", F.explode(F.when(F.col("id") == F.col("c"), every).otherwise(F.array(own(F.col("n"))))).alias("part")
    )
    linked = _blocks(placed, payloads, ["grp", "part"]).mapInArrow(_star_edges(compare), "a long, b long")
    first = cut_lineage(linked, f"{label}-links")

    large = many.where(F.col("n") > size)
    if large.isEmpty():
        return first
    roots = components(first, label)
    main = roots.select(F.col("id").alias("c"), F.col("root").alias("main"))
    sided = (
        large.join(roots, "id", "left")
        .join(main, "c", "left")
        .select("grp", "id", (F.coalesce("root", "id") == F.coalesce("main", "c")).alias("inside"))
    )
    sided = cut_lineage(sided, f"{label}-sides")
    sides = (
        sided.groupBy("grp")
        .agg(F.count_if("inside").alias("n_in"), F.count_if(~F.col("inside")).alias("n_out"))
        .where("n_out > 0")
    )
    rest = sided.join(sides, "grp")
    n_in, n_out = cut(F.col("n_in")), cut(F.col("n_out"))

    def steps(n):
        return F.sequence(F.lit(0), n - 1)

    inner = own(F.col("n_in"))
    outer = own(F.col("n_out"))
    cell = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.cast("int").alias("x"), y.cast("int").alias("y"))
    cells = F.when(F.col("inside"), F.transform(steps(n_out), lambda j: cell("in", inner, j))).otherwise(
        F.concat(
            F.transform(steps(n_in), lambda i: cell("in", i, outer)),
            F.transform(steps(n_out), lambda j: cell("out", F.least(outer, j), F.greatest(outer, j))),
        )
    )
    met = rest.select("grp", "id", F.explode(cells).alias("cell"))
    second = _blocks(met, payloads, ["grp", "cell"]).mapInArrow(_star_edges(compare), "a long, b long")
    return first.union(cut_lineage(second, f"{label}-links"))
