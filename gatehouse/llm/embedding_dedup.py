"""Near-duplicates of vectors by cosine, compared tile by tile in the order of principal axes.

Vectors are scaled to length one and turned onto their principal axes, which changes no cosine.
The leading axes hold most of the length. Of a pair of vectors, the product of the leading
coordinates plus the product of the lengths of the two rests (Cauchy-Schwarz) bounds the cosine
from above, so most pairs are given up after a few coordinates. Survivors go on with twice as
many, and what is left is computed in full, in double precision, from the vectors themselves.

Equal vectors form one class and only classes are compared. Classes are dealt into groups by a
hash; a task compares two groups, sorted along the first axis and cut into tiles, and skips
tiles that lie too far apart. Tasks give out sums of links and a spanning forest, never pairs,
so a large group of near copies costs no more rows than any other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatehouse.llm.components import components
from gatehouse.session import stored

#: Classes in a group at most, on average; the least number of groups; vectors in a tile.
GROUP_ROWS, GROUPS, TILE = 16_384, 12, 1024
#: Vectors from which the axes are found. Any axes give right results; these give fast ones.
AXES_ROWS = 8_192
#: Share of a tile's pairs from which on the whole tile is computed in full.
DENSE = 0.02

_LINKS = "rep long, links long, root long"


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares of very large or small numbers stay finite.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """Orthonormal axes as columns, those that hold most of the length first."""
    unit = _unit(sample)
    _, axes = np.linalg.eigh(unit.T @ unit)
    return axes[:, ::-1].copy()


def _forest(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, column) that connect the rows and columns of a tile as its mask does."""
    rows, columns = mask.any(axis=1), mask.any(axis=0)
    label_r, label_c = np.arange(len(rows)), np.full(len(columns), len(rows))
    while True:
        new_c = np.minimum(label_c, np.where(mask, label_r[:, None], len(rows)).min(axis=0))
        new_r = np.minimum(label_r, np.where(mask, new_c[None, :], len(rows)).min(axis=1))
        if (new_r == label_r).all() and (new_c == label_c).all():
            break
        label_r, label_c = new_r, new_c
    # A star of columns around the first row of each part, and the other rows through a column.
    columns, rows = np.flatnonzero(columns), np.flatnonzero(rows)
    via = np.full(len(label_r), -1)
    via[label_c[columns]] = columns
    return np.concatenate([label_c[columns], rows]), np.concatenate([columns, via[label_r[rows]]])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of the part of each node, by hooking and shortcutting."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _tile_pairs(low: np.ndarray, high: np.ndarray, first: np.ndarray, second: np.ndarray, reach: float):
    """Pairs of tiles whose boxes along the leading axes are within reach."""
    gap = np.maximum(low[first][:, None] - high[second][None, :], low[second][None, :] - high[first][:, None])
    near = (np.maximum(gap, 0) ** 2).sum(axis=2) <= reach
    return zip(*(x.tolist() for x in np.nonzero(near)), strict=True)


def _compare_groups(axes: np.ndarray, threshold: float, groups: int):
    dim = len(axes)
    lead, more = max(dim // 4, 1), max(dim // 2, 1)
    # Rounding of single precision in the first bound.
    slack = 1e-5 * max(1.0, dim / 256)

    def run(table: pa.Table) -> pa.Table:
        pair = table.column("pair")[0].as_py()
        vectors = table.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, dim).astype(np.float64)
        rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        side = table.column("side").to_numpy()
        unit = _unit(vectors)
        turned = unit @ axes
        order = np.lexsort((turned[:, 0], side))
        rep, copies, side, unit, turned = rep[order], copies[order], side[order], unit[order], turned[order]
        rest = [np.sqrt(np.maximum((turned[:, k:] ** 2).sum(axis=1), 0)) for k in (lead, more)]
        leading = np.concatenate([turned[:, :lead], rest[0][:, None]], axis=1).astype(np.float32)
        middle = np.concatenate([turned[:, :more], rest[1][:, None]], axis=1)

        left = int((side == 0).sum())
        cuts = [*range(0, left, TILE), *range(left, len(rep), TILE), len(rep)]
        tiles = list(zip(cuts[:-1], cuts[1:], strict=True))
        low = np.array([turned[a:b, : min(4, dim)].min(axis=0) for a, b in tiles])
        high = np.array([turned[a:b, : min(4, dim)].max(axis=0) for a, b in tiles])
        split = sum(a < left for a, _ in tiles)
        alone = pair // groups == pair % groups
        first = np.arange(split)
        second = first if alone else np.arange(split, len(tiles))

        links = np.zeros(len(rep), np.int64)
        ends: tuple[list, list] = ([], [])
        for i, j in _tile_pairs(low, high, first, second, 2 * (1 - threshold) + slack):
            if alone and j < i:
                continue
            (a, b), (c, d) = tiles[first[i]], tiles[second[j]]
            maybe = leading[a:b] @ leading[c:d].T >= threshold - slack
            if alone and i == j:
                maybe = np.triu(maybe, 1)
            n = np.count_nonzero(maybe)
            if not n:
                continue
            if n > DENSE * maybe.size:
                linked = (unit[a:b] @ unit[c:d].T >= threshold) & maybe
                links[a:b] += linked @ copies[c:d]
                links[c:d] += copies[a:b] @ linked
                if linked.any():
                    x, y = _forest(linked)
                    ends[0].append(x + a)
                    ends[1].append(y + c)
                continue
            x, y = np.nonzero(maybe)
            x, y = x + a, y + c
            for values, least in ((middle, threshold - 1e-9), (unit, threshold)):
                keep = np.einsum("ij,ij->i", values[x], values[y]) >= least
                x, y = x[keep], y[keep]
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            ends[0].append(x)
            ends[1].append(y)
        if not ends[0]:
            return table.schema.empty_table().select(["rep", "copies"]).append_column("root", pa.array([], pa.int64())).rename_columns(["rep", "links", "root"])
        x, y = np.concatenate(ends[0]), np.concatenate(ends[1])
        root = _roots(len(rep), x, y)
        found = links > 0
        return pa.table({"rep": rep[found], "links": links[found], "root": rep[root[found]]})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row.

    Two rows link if the cosine of their vectors is `threshold` or more; n_links counts the other
    rows that link with a row directly, component_id is the smallest identifier that links
    reach, and kept is true for that one.

    A vector that is null, empty, zero, or holds a null or non-finite component links with
    nothing, and neither do vectors of different lengths: n_links 0, its own component, kept.
    A row without identifier links with nothing, its component is null and it is kept. Equal
    vectors link. Rows that repeat an identifier are rows of their own. Other columns are not
    looked at. An empty table gives an empty result.
    """
    value = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), value.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.coalesce((F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    # Two hashes name a class; the second sees the components in the other direction.
    keyed = rows.withColumns({"k1": F.when(usable, F.xxhash64("vector")), "k2": F.when(usable, F.xxhash64(F.reverse("vector"), F.lit(1)))})
    classes = stored(
        keyed.filter(F.col("k1").isNotNull())
        .groupBy("k1", "k2")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")),
        "classes",
    )
    found = None
    for dim, n in sorted(classes.groupBy(F.size("vector").alias("dim")).count().collect()):
        own = classes.filter(F.size("vector") == dim)
        sample = own.select("rep", "vector").orderBy(F.xxhash64("rep"), "rep").limit(AXES_ROWS).collect()
        axes = principal_axes(np.array([r["vector"] for r in sample]))
        groups = max(GROUPS, math.ceil(n / GROUP_ROWS))
        group = F.pmod(F.xxhash64("k1"), F.lit(groups))
        # Group g meets the groups from g on as the first side, those before it as the second.
        partners = F.transform(
            F.sequence(F.lit(0), F.lit(groups - 1)),
            lambda p: F.struct((F.least(p, "group") * groups + F.greatest(p, "group")).cast("long").alias("pair"), (p < F.col("group")).cast("int").alias("side")),
        )
        dealt = own.withColumn("group", group.cast("int")).select("rep", "copies", "vector", F.explode(partners).alias("p")).select("p.*", "rep", "copies", "vector")
        links = dealt.groupBy("pair").applyInArrow(_compare_groups(axes, threshold, groups), _LINKS)
        found = links if found is None else found.union(links)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], _LINKS)
    found = stored(found, "links-of-classes")
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found, "rep", "root").withColumnRenamed("node", "rep")
    told = classes.select("k1", "k2", "rep", "copies").join(sums, "rep", "left").join(parts, "rep", "left")
    return keyed.select("vec_id", "k1", "k2").join(told, ["k1", "k2"], "left").select(
        "vec_id",
        (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "rep", "vec_id"), F.lit(True)).alias("kept"),
    )
