"""Node keys and geometry: columns over (n, lx, ly, lz). Unused dimensions hold 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mwspark.mra import AXES, COORDS, KEY, MRA, World


def root_cells(spark: SparkSession, world: World) -> DataFrame:
    """The root cells, x fastest: box, n and translations."""
    box = spark.range(world.count).select(F.col("id").cast("int").alias("box"))
    cols, rest = [F.lit(world.scale).alias("n")], F.col("box")
    for d, name in enumerate(AXES):
        if d < world.dim:
            cols.append((rest % world.boxes[d] + world.corner[d]).cast("int").alias(name))
            rest = F.floor(rest / world.boxes[d])
        else:
            cols.append(F.lit(0).alias(name))
    return box.select("box", *cols)


def _box_of(per_dim: list[Column], world: World) -> Column:
    inside = reduce(lambda a, b: a & b, [(c >= 0) & (c < world.boxes[d]) for d, c in enumerate(per_dim)])
    index, step = F.lit(0), 1
    for d, c in enumerate(per_dim):
        index, step = index + c * step, step * world.boxes[d]
    return F.when(inside, index).otherwise(-1).cast("int")


def in_world(coord: Column, world: World, d: int) -> Column:
    """The coordinate in units of sf, wrapped into the world where that dimension is periodic."""
    u = coord / world.sf[d]
    if not world.periodic[d]:
        return u
    low, length = world.corner[d] * world.unit, world.boxes[d] * world.unit
    return u - F.floor((u - low) / length) * length


def cell_of_point(world: World) -> Column:
    """Root box of a point (x, y, z), half-open; -1 outside."""
    return _box_of([F.floor(in_world(F.col(COORDS[d]), world, d) / world.unit) - world.corner[d] for d in range(world.dim)], world)


def root_of_node(world: World) -> Column:
    """Root box of a node (n at or below the root scale); -1 outside."""
    # a shift to the right rounds down for negative translations, too
    return _box_of([F.expr(f"shiftright({AXES[d]}, n - ({world.scale}))") - world.corner[d] for d in range(world.dim)], world)


def parent_key() -> list[Column]:
    return [(F.col("n") - 1).alias("n"), *[F.shiftright(a, 1).alias(a) for a in AXES]]


def children(cells: DataFrame, dim: int, levels: int = 1) -> DataFrame:
    """Every cell replaced by its descendants so many levels down; child says which of the parent's children it is. Joins merge, as with ancestors."""
    c = F.explode(F.sequence(F.lit(0), F.lit((1 << dim) - 1))).alias("child")
    for _ in range(levels):
        cells = cells.drop("child").select("*", c)
        cells = cells.withColumns({"n": F.col("n") + 1} | {AXES[d]: F.col(AXES[d]) * 2 + F.expr(f"shiftright(child, {d}) & 1") for d in range(dim)})
    return cells.hint("merge")


def ancestors(cells: DataFrame, root_scale: int, itself: bool = True) -> DataFrame:
    """Every cell with the keys of itself and all ancestors down to the root scale as (an, ax, ay, az): an equi-join key for lookups.

    Joins with the result are merged by a shuffle: the optimizer doesn't see how many rows an explode makes and would broadcast them.
    """
    first = F.lit(0) if itself else F.lit(1)
    up = F.when(F.col("n") - root_scale >= first, F.sequence(first, F.col("n") - root_scale)).otherwise(F.array().cast("array<int>"))
    out = cells.withColumn("up", F.explode(up))
    return out.select("*", (F.col("n") - F.col("up")).alias("an"), *[F.expr(f"shiftright({a}, up)").alias("a" + a[1]) for a in AXES]).drop("up").hint("merge")


def is_ancestor(a: str, b: str) -> Column:
    """Whether node a is node b or one of its ancestors."""
    gap = f"({b}.n - {a}.n)"
    return F.expr(f"{gap} >= 0") & reduce(lambda x, y: x & y, [F.expr(f"shiftright({b}.{k}, greatest({gap}, 0)) = {a}.{k}") for k in AXES])


def related(a: str, b: str) -> Column:
    return is_ancestor(a, b) | is_ancestor(b, a)


def siblings(a: str, b: str) -> Column:
    return F.expr(f"{a}.n = {b}.n") & reduce(lambda x, y: x & y, [F.expr(f"shiftright({a}.{k}, 1) = shiftright({b}.{k}, 1)") for k in AXES])


def node_bounds(world: World) -> list[Column]:
    """Physical bounds (lo_x, hi_x, ..) and centre (mid_x, ..) of a node."""
    out = []
    for d in range(world.dim):
        side = F.lit(world.sf[d]) * F.pow(F.lit(2.0), -F.col("n"))
        c = COORDS[d]
        out += [(F.col(AXES[d]) * side).alias(f"lo_{c}"), ((F.col(AXES[d]) + 1) * side).alias(f"hi_{c}"), ((F.col(AXES[d]) + 0.5) * side).alias(f"mid_{c}")]
    return out


def child_of_node(n: Column, translations: list[Column]) -> Column:
    """Which child of its ancestor at scale n holds the node (n, lx, ..) of the row."""
    bits = [(1 << d) * F.pmod(F.floor(t / F.pow(F.lit(2.0), F.col("n") - n - 1)), F.lit(2)) for d, t in enumerate(translations)]
    return reduce(lambda a, b: a + b, bits).cast("int")


def child_of_point(world: World) -> Column:
    """Which child of the row's node holds the row's point: the upper one only strictly beyond the middle."""
    out = F.lit(0)
    for d in range(world.dim):
        mid = (F.col(AXES[d]) + 0.5) * F.pow(F.lit(2.0), -F.col("n"))
        out = out + F.when(in_world(F.col(COORDS[d]), world, d) > mid, 1 << d).otherwise(0)
    return out


def wrap_index(world: World, n: Column | None = None) -> list[Column]:
    """Translations at scale n (the column n) wrapped into a periodic world; other dimensions stay."""
    out = []
    cells = F.pow(F.lit(2), (F.col("n") if n is None else n) - world.scale)
    for d, name in enumerate(AXES):
        if d < world.dim and world.periodic[d]:
            per, low = (F.lit(world.boxes[d]) * cells).cast("int"), (F.lit(world.corner[d]) * cells).cast("int")
            out.append((F.pmod(F.col(name) - low, per) + low).cast("int").alias(name))
        else:
            out.append(F.col(name))
    return out


def wrap_coord(world: World, d: int) -> Column:
    return in_world(F.col(COORDS[d]), world, d) * world.sf[d]


def in_unit_cell(world: World) -> Column:
    return root_of_node(world) >= 0


def out_of_bounds(lower: list[float], upper: list[float]) -> Column:
    """Half-open bounds [lower, upper) in each dimension; a function without bounds is never out of them."""
    if not lower:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [(F.col(c) < lo) | (F.col(c) >= hi) for c, lo, hi in zip(COORDS, lower, upper, strict=False)])


def point_key(world: World, n: int) -> list[Column]:
    """The key of the cell at scale n that holds the row's point."""
    cols = [F.lit(n).alias("n")]
    for d, name in enumerate(AXES):
        cols.append(F.floor(in_world(F.col(COORDS[d]), world, d) * 2.0**n).cast("int").alias(name) if d < world.dim else F.lit(0).alias(name))
    return cols


def quadrature_points(nodes: DataFrame, mra: MRA) -> DataFrame:
    """The quadrature points of each node's children, with weights: one row per point."""
    from mwspark.functions.basis import child_steps, lattice

    unit, weight = lattice(mra.dim, mra.k)
    points = [(*((s + u) / 2), w / 2**mra.dim) for s in child_steps(mra.dim) for u, w in zip(unit, weight, strict=True)]
    schema = ", ".join([*[f"u{c} double" for c in COORDS[: mra.dim]], "w double"])
    # (2K)^D rows, fixed by the basis
    table = F.broadcast(nodes.sparkSession.createDataFrame([tuple(map(float, p)) for p in points], schema).withColumn("one", F.lit(1)))
    side = F.pow(F.lit(2.0), -F.col("n"))
    joined = nodes.withColumn("one", F.lit(1)).join(table, "one").drop("one")
    coords = [((F.col(AXES[d]) + F.col(f"u{COORDS[d]}")) * side * mra.world.sf[d]).alias(COORDS[d]) for d in range(mra.dim)]
    return joined.select(*nodes.columns, *coords, (F.col("w") * F.pow(side, F.lit(mra.dim)) * mra.world.volume_factor).alias("weight"))


def end_nodes(nodes: DataFrame, tree_key: bool = True) -> DataFrame:
    """Nodes that are no node's parent, whatever is_end says."""
    keys = (["tree_id"] if tree_key else []) + KEY
    parents = nodes.select(*(["tree_id"] if tree_key else []), *parent_key()).distinct()
    return nodes.join(parents, keys, "left_anti")


def roots(nodes: DataFrame, world: World) -> DataFrame:
    return nodes.where(F.col("n") == world.scale)


def find_node(keys: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """Existing nodes only: nulls where the tree has none."""
    return keys.join(nodes, by, "left")


def end_node_of(keys: DataFrame, leaves: DataFrame, world: World, tree_key: bool = False) -> DataFrame:
    """For each key the end node (n, l as en, ex, ey, ez) that is it or its ancestor; keys outside find none.

    The keys are exploded to their ancestors, so that the lookup is an equi-join with at most one match.
    """
    names = ["en", "ex", "ey", "ez"]
    tree = ["tree_id"] if tree_key else []
    ends = leaves.select(*tree, *[F.col(k).alias(e) for k, e in zip(KEY, names, strict=True)], *[c for c in leaves.columns if c not in [*KEY, *tree] and c not in keys.columns])
    up = ancestors(keys, world.scale)
    on = [F.col(f"up.a{k[-1]}") == F.col(f"e.{e}") for k, e in zip(["an", "ax", "ay", "az"], names, strict=True)]
    on += [F.col("up.tree_id") == F.col("e.tree_id")] if tree_key else []
    keep = [F.col(f"up.{c}") for c in keys.columns] + [F.col(f"e.{c}") for c in ends.columns if c not in tree]
    return up.alias("up").join(ends.alias("e"), reduce(lambda a, b: a & b, on)).select(*keep)
