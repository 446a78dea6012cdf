"""Changes of a mesh's connectivity, as rounds of independent local steps over all meshes at once.

A mesh is never one group: what a step needs of its surroundings comes by equi-joins on vertices
and sides, steps that touch each other are told apart by minima over their surroundings, and each
round's tables are written, so that plans stay short. scratch(df, name) writes a table under a
name that wasn't used before and reads it back (plans.scratch.writer).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import geometry as g
from voxloom.operators.mesh import edges, with_corners


def at(vertices: DataFrame, name: str, *more: str) -> DataFrame:
    """Vertices keyed by `name`, their columns with that prefix."""
    return vertices.select("mesh_id", F.col("vid").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("x", "y", "z", *more)])


def position(name: str) -> tuple:
    return g.vec(*(f"{name}_{c}" for c in "xyz"))


def shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that is dealt by its keys at any size: a broadcast in each of many rounds would send it through the driver as often."""
    return side.hint("merge")


# Backbones.
HALF = ("mesh_id", "u", "v")


def doubled(halves: DataFrame, scratch, name: str) -> DataFrame:
    """(mesh_id, u, v, pu, pv, steps, least, done): of each half-edge (u, v, nu, nv) the last one of its chain, by pointer doubling.

    nu, nv: the next half-edge, null at an end. least: the least vertex on the way. Half-edges on a
    circle are never done; their way has then been round it, and `least` is the circle's. A round
    doubles the way, so the logarithm of the longest chain is the number of rounds.
    """
    now = halves.select(*HALF, F.coalesce("nu", "u").alias("pu"), F.coalesce("nv", "v").alias("pv"), F.when(F.col("nu").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.least("u", F.coalesce("nu", "u")).alias("least"), F.col("nu").isNull().alias("done"))
    now, reach = scratch(now, f"{name}-0"), 1
    while True:
        left = now.where("NOT done").groupBy("mesh_id").count().agg(F.max("count")).first()[0]
        if not left or reach >= 2 * left:
            return now
        reach *= 2
        ahead = now.select("mesh_id", F.col("u").alias("pu"), F.col("v").alias("pv"), F.col("pu").alias("qu"), F.col("pv").alias("qv"), F.col("steps").alias("more"), F.col("least").alias("less"), F.col("done").alias("ends"))
        moved = now.where("NOT done").join(shuffled(ahead), ["mesh_id", "pu", "pv"]).select(*HALF, F.col("qu").alias("pu"), F.col("qv").alias("pv"), (F.col("steps") + F.col("more")).alias("steps"), F.least("least", "less").alias("least"), F.col("ends").alias("done"))
        now = scratch(now.where("done").unionByName(moved), f"{name}-{reach}")


def backbones(features: DataFrame, scratch) -> DataFrame:
    """(mesh_id, first, second, place, vid, closed): chains of feature edges (mesh_id, u, v) between corners, and closed ones.

    A corner is a vertex of any number of feature edges but two. A chain is named by its first two
    vertices: an open one begins at its lesser end (with equal ends, towards the lesser neighbour),
    a closed one at its least vertex, towards the lesser neighbour; place counts its vertices from
    0, and a closed chain doesn't repeat its first vertex.
    """
    sides = features.select("mesh_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    both = sides.unionByName(sides.select("mesh_id", F.col("v").alias("u"), F.col("u").alias("v")))
    degrees = both.groupBy("mesh_id", "u").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    inner = degrees.where("n = 2").select("mesh_id", F.col("u").alias("v"), "total")  # of two neighbours the other is the sum less the one
    halves = scratch(both.join(shuffled(inner), ["mesh_id", "v"], "left").select(*HALF, F.when(F.col("total").isNotNull(), F.col("v")).alias("nu"), (F.col("total") - F.col("u")).alias("nv")), "halves")
    ways = doubled(halves, scratch, "open")
    back = ways.where("done").select("mesh_id", F.col("v").alias("u"), F.col("u").alias("v"), F.col("pv").alias("first"), F.col("pu").alias("second"), F.col("steps").alias("before"))
    chains = ways.where("done").join(shuffled(back), list(HALF))  # where it ends, and by the way back where it begins
    chains = chains.where("first < pv OR (first = pv AND second < pu)").select(*HALF, "first", "second", F.col("before").alias("place"), "steps")
    opened = chains.select("mesh_id", "first", "second", "place", F.col("u").alias("vid")).unionByName(chains.where("steps = 0").select("mesh_id", "first", "second", (F.col("place") + 1).alias("place"), F.col("v").alias("vid")))
    circles = ways.where("NOT done")
    start = circles.where("u = least").groupBy("mesh_id", "least").agg(F.min("v").alias("second"), F.max("v").alias("last"))
    # One of the two ways round: that in which the last vertex comes before the first. It is cut there.
    cut = circles.select(*HALF, "least").join(shuffled(start), ["mesh_id", "least"]).join(shuffled(halves), list(HALF)).withColumnRenamed("least", "first")
    cut = scratch(cut.select(*HALF, *[F.when(F.col("v") != F.col("first"), F.col(c)).alias(c) for c in ("nu", "nv")], "first", "second", "last"), "cut")
    rounds = doubled(cut, scratch, "closed").join(shuffled(cut.select(*HALF, "first", "second", "last")), list(HALF)).where("pu = last")
    size = rounds.where("u = first").select("mesh_id", "first", F.col("steps").alias("all"))
    closed = rounds.join(shuffled(size), ["mesh_id", "first"]).select("mesh_id", "first", "second", (F.col("all") - F.col("steps")).alias("place"), F.col("u").alias("vid"))
    return opened.withColumn("closed", F.lit(False)).unionByName(closed.withColumn("closed", F.lit(True)))


# Delaunay by flips.
def cotangent(tip: tuple, p: tuple, q: tuple) -> Column:
    """Of the angle at tip."""
    a, b = g.sub(p, tip), g.sub(q, tip)
    return F.try_divide(g.dot(a, b), g.norm(g.cross(a, b)))


def least_cosine(p: tuple, q: tuple, r: tuple) -> Column:
    """The cosine of the least angle of a triangle: the greatest of the three."""
    of = lambda tip, a, b: F.try_divide(g.dot(g.sub(a, tip), g.sub(b, tip)), g.norm(g.sub(a, tip)) * g.norm(g.sub(b, tip)))
    return F.greatest(of(p, q, r), of(q, r, p), of(r, p, q))


def side_pairs(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(mesh_id, u, v, f, a, h, b, ...): sides of two faces f and h that run in opposite directions, u to v in f, with the corners opposite, and all four positions."""
    sides = edges_directed(faces)
    ours = sides.where("u < v").select("mesh_id", "u", "v", F.col("fid").alias("f"), F.col("opposite").alias("a"))
    theirs = sides.where("u > v").select("mesh_id", F.col("v").alias("u"), F.col("u").alias("v"), F.col("fid").alias("h"), F.col("opposite").alias("b"))
    single = sides.groupBy("mesh_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.count("*").alias("n")).where("n = 2").drop("n")
    out = ours.join(shuffled(theirs), ["mesh_id", "u", "v"]).join(shuffled(single), ["mesh_id", "u", "v"]).where("a <> b")
    for name in ("u", "v", "a", "b"):
        out = out.join(shuffled(at(vertices, name)), ["mesh_id", name])
    return out


def edges_directed(faces: DataFrame) -> DataFrame:
    """(mesh_id, fid, u, v, opposite): the sides of faces as they run."""
    sides = F.explode(F.array(*[F.struct(F.col(f"v{i}").alias("u"), F.col(f"v{j}").alias("v"), F.col(f"v{k}").alias("opposite")) for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1))]))
    return faces.select("mesh_id", "fid", sides.alias("e")).select("mesh_id", "fid", "e.*")


def opposed(eps: float = 1e-9) -> Column:
    """Whether a side of side_pairs() fails the circle test: the angles opposite it are more than two right angles together."""
    return cotangent(position("a"), position("u"), position("v")) + cotangent(position("b"), position("u"), position("v")) < -eps


def convex() -> Column:
    """Whether both faces of the other diagonal would look the way the two faces do."""
    p, q, r, s = position("u"), position("v"), position("a"), position("b")
    normal = lambda i, j, k: g.cross(g.sub(j, i), g.sub(k, i))
    old = g.add(normal(p, q, r), normal(q, p, s))
    return (g.dot(normal(s, q, r), old) > 0) & (g.dot(normal(p, s, r), old) > 0)


def flipped(faces: DataFrame, vertices: DataFrame, scratch, kept: DataFrame | None = None, most_rounds: int | None = None) -> DataFrame:
    """Faces after flips of all sides that fail the circle test, until none is left that can be flipped.

    A side is flipped where both new faces look the way the old ones do (in a plane: where the four
    corners are convex), the least angle grows, the other diagonal isn't a side yet, and the side isn't
    one of `kept` (mesh_id, u, v), such as feature edges. Each flip makes the sorted angles of its mesh
    greater, so this ends. In a round those flips are done that come first, in an order by hash, for both
    their faces, and alone for their new side; faces keep their numbers.
    """
    p, q, r, s = position("u"), position("v"), position("a"), position("b")
    better = F.greatest(least_cosine(s, q, r), least_cosine(p, s, r)) < F.greatest(least_cosine(p, q, r), least_cosine(q, p, s))
    now, done = faces.select("mesh_id", "fid", "v0", "v1", "v2"), 0
    points = vertices.select("mesh_id", "vid", "x", "y", "z")
    while most_rounds is None or done < most_rounds:
        bad = side_pairs(now, points).where(opposed() & convex() & better)
        fresh = bad.select("mesh_id", "u", "v", "f", "h", "a", "b", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.xxhash64("mesh_id", "u", "v", F.lit(done)).alias("turn"))
        there = edges(now).select("mesh_id", F.col("u").alias("lo"), F.col("v").alias("hi")).distinct()
        fresh = fresh.join(shuffled(there), ["mesh_id", "lo", "hi"], "left_anti")
        if kept is not None:
            fresh = fresh.join(shuffled(kept.select("mesh_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()), ["mesh_id", "u", "v"], "left_anti")
        fresh = scratch(fresh, f"bad-{done}")
        own = F.struct("turn", "u", "v")
        held = fresh.select("mesh_id", F.explode(F.array(*[F.struct(F.col(a).cast("long").alias("p"), b.cast("long").alias("q")) for a, b in (("f", F.lit(-1)), ("h", F.lit(-1)), ("lo", F.col("hi")))])).alias("held"), own.alias("own"))
        first = held.groupBy("mesh_id", "held").agg(F.min("own").alias("own")).groupBy("mesh_id", "own").agg(F.count("*").alias("n")).where("n = 3")
        chosen = fresh.join(shuffled(first.select("mesh_id", "own.u", "own.v")), ["mesh_id", "u", "v"])
        new = chosen.select("mesh_id", F.explode(F.array(F.struct(F.col("f").alias("fid"), F.col("b").alias("v0"), F.col("v").alias("v1"), F.col("a").alias("v2")), F.struct(F.col("h").alias("fid"), F.col("u").alias("v0"), F.col("b").alias("v1"), F.col("a").alias("v2")))).alias("n")).select("mesh_id", "n.*")
        if fresh.isEmpty():
            break
        new = scratch(new, f"new-{done}")
        now = scratch(now.join(shuffled(new), ["mesh_id", "fid"], "left_anti").unionByName(new), f"faces-{done}")
        done += 1
    return now


# Decimation.
QUADRIC = tuple(f"q{i}{j}" for i in range(4) for j in range(i, 4))


def plane_quadric(n: tuple, d: Column, weight: Column) -> list[Column]:
    plane = (*n, d)
    return [(weight * plane[i] * plane[j]).alias(f"q{i}{j}") for i in range(4) for j in range(i, 4)]


def quadric_cost(q: dict[str, Column], p: tuple) -> Column:
    """The weighted sum of squared distances to the planes of a quadric."""
    x = (*p, F.lit(1.0))
    total = F.lit(0.0)
    for i in range(4):
        for j in range(i, 4):
            total = total + q[f"q{i}{j}"] * x[i] * x[j] * (1.0 if i == j else 2.0)
    return F.greatest(total, F.lit(0.0))


def vertex_quadrics(vertices: DataFrame, faces: DataFrame, border: float = 10.0) -> DataFrame:
    """vertices with the sums of their faces' plane quadrics by area, and of upright planes through sides of one face."""
    corners = with_corners(faces, shuffled(vertices))
    a, b, c = (g.vec(*(f"{p}{n}" for n in "xyz")) for p in "akc")
    n = g.cross(g.sub(b, a), g.sub(c, a))
    size = g.norm(n)
    unit = tuple(F.try_divide(x, size) for x in n)
    planes = corners.select("mesh_id", "fid", F.explode(F.array("v0", "v1", "v2")).alias("vid"), *plane_quadric(unit, -g.dot(unit, a), size / 2))
    normals = corners.select("mesh_id", "fid", *[x.alias(f"n{c}") for x, c in zip(unit, "xyz", strict=True)])
    rim = edges(faces).groupBy("mesh_id", "u", "v").agg(F.count("*").alias("n"), F.first("fid").alias("fid")).where("n = 1")
    rim = rim.join(shuffled(normals), ["mesh_id", "fid"]).join(shuffled(at(vertices, "u")), ["mesh_id", "u"]).join(shuffled(at(vertices, "v")), ["mesh_id", "v"])
    along = g.sub(position("v"), position("u"))
    up = g.cross(along, g.vec("nx", "ny", "nz"))
    flat = tuple(F.try_divide(x, g.norm(up)) for x in up)
    walls = rim.select("mesh_id", "fid", F.explode(F.array("u", "v")).alias("vid"), *plane_quadric(flat, -g.dot(flat, position("u")), border * g.dot(along, along)))
    total = planes.unionByName(walls).groupBy("mesh_id", "vid").agg(*[F.sum(F.coalesce(q, F.lit(0.0))).alias(q) for q in QUADRIC])
    return vertices.select("mesh_id", "vid", "x", "y", "z").join(shuffled(total), ["mesh_id", "vid"])


def collapses(vertices: DataFrame, faces: DataFrame, sides: DataFrame, scratch, turn: float = 0.2) -> DataFrame:
    """(mesh_id, u, v, cost, x, y, z): sides that may be drawn together, to the least costly of both ends and the middle.

    A side may go if its ends have no common neighbours but the corners opposite it (else the mesh
    would no longer be a manifold), isn't an inner side between border vertices, and no other face of
    its ends is turned by more than the cosine `turn`. A border vertex stays on its place if the other isn't one.
    sides: those of the faces (mesh_id, u, v, n), with their numbers of faces. What is used twice is written
    by scratch(df, name), as each use would plan it again.
    """
    border = sides.where("n = 1").select("mesh_id", F.explode(F.array("u", "v")).alias("vid")).distinct().withColumn("rim", F.lit(True))
    points = scratch(vertices.join(shuffled(border), ["mesh_id", "vid"], "left").withColumn("rim", F.coalesce("rim", F.lit(False))), "rims")
    both = sides.where("n <= 2")
    for name in ("u", "v"):
        both = both.join(shuffled(at(points, name, "rim", *QUADRIC)), ["mesh_id", name])
    both = both.where("n = 1 OR NOT (u_rim AND v_rim)")
    q = {c: F.col(f"u_{c}") + F.col(f"v_{c}") for c in QUADRIC}
    middle = tuple((a + b) / 2 for a, b in zip(position("u"), position("v"), strict=True))
    choice = lambda p, allowed: F.when(allowed, F.struct(quadric_cost(q, p).alias("cost"), *[c.alias(n) for n, c in zip("xyz", p, strict=True)]))
    free = F.col("u_rim") == F.col("v_rim")
    best = F.array_min(F.array_compact(F.array(choice(middle, free), choice(position("u"), free | F.col("u_rim")), choice(position("v"), free | F.col("v_rim")))))
    both = scratch(both.select("mesh_id", "u", "v", "n", best.alias("best")).select("mesh_id", "u", "v", "n", "best.*"), "best")
    around = sides.select("mesh_id", "u", "v").unionByName(sides.select("mesh_id", F.col("v").alias("u"), F.col("u").alias("v")))
    common = both.select("mesh_id", "u", "v").join(shuffled(around.select("mesh_id", "u", F.col("v").alias("w"))), ["mesh_id", "u"]).join(shuffled(around.select("mesh_id", F.col("u").alias("v"), F.col("v").alias("w"))), ["mesh_id", "v", "w"])
    both = scratch(both.join(shuffled(common.groupBy("mesh_id", "u", "v").agg(F.count("*").alias("shared"))), ["mesh_id", "u", "v"]).where("shared = n").drop("shared", "n"), "manifold")
    fans = edges_directed(faces).select("mesh_id", F.col("opposite").alias("vid"), F.col("u").alias("p"), F.col("v").alias("q")).join(shuffled(at(points, "vid")), ["mesh_id", "vid"]).join(shuffled(at(points, "p")), ["mesh_id", "p"]).join(shuffled(at(points, "q")), ["mesh_id", "q"])
    new = g.vec("x", "y", "z")
    before = g.cross(g.sub(position("p"), position("vid")), g.sub(position("q"), position("vid")))
    after = g.cross(g.sub(position("p"), new), g.sub(position("q"), new))
    bad = ~(g.dot(before, after) > turn * g.norm(before) * g.norm(after)) | (g.norm(after) < 1e-12)
    ends = both.select("mesh_id", "u", "v", "x", "y", "z", F.explode(F.array(*[F.struct(F.col(a).alias("vid"), F.col(b).alias("other")) for a, b in ("uv", "vu")])).alias("e")).select("mesh_id", "u", "v", "x", "y", "z", "e.*")
    turned = ends.join(shuffled(fans), ["mesh_id", "vid"]).where((F.col("p") != F.col("other")) & (F.col("q") != F.col("other")) & bad).select("mesh_id", "u", "v").distinct()
    return both.join(shuffled(turned), ["mesh_id", "u", "v"], "left_anti")


def independent(some: DataFrame, sides: DataFrame) -> DataFrame:
    """Those of the sides (mesh_id, u, v, cost) that are the least among all that touch them or a neighbour of theirs; sides (mesh_id, u, v): all there are."""
    around = sides.select("mesh_id", F.col("u").alias("vid"), F.col("v").alias("other")).unionByName(sides.select("mesh_id", F.col("v").alias("vid"), F.col("u").alias("other")))
    own = F.struct("cost", F.xxhash64("mesh_id", "u", "v").alias("tie"), "u", "v")
    ends = some.select("mesh_id", F.explode(F.array("u", "v")).alias("vid"), own.alias("own"))
    least = ends.groupBy("mesh_id", "vid").agg(F.min("own").alias("own"))
    near = around.join(shuffled(least.withColumnRenamed("vid", "other")), ["mesh_id", "other"]).select("mesh_id", "vid", "own").unionByName(least).groupBy("mesh_id", "vid").agg(F.min("own").alias("own"))
    both = near.groupBy("mesh_id", "own").agg(F.count_if((F.col("vid") == F.col("own.u")) | (F.col("vid") == F.col("own.v"))).alias("n")).where("n = 2")
    return some.join(shuffled(both.select("mesh_id", "own.u", "own.v")), ["mesh_id", "u", "v"])


def decimated(vertices: DataFrame, faces: DataFrame, budgets: DataFrame, scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, faces, merged): meshes brought down to their budget (mesh_id, budget) of vertices, by rounds of independent collapses of least cost.

    A round draws together, in all meshes above their budget, the sides that are the least costly of
    their surroundings; where a mesh needs fewer, the cheapest of these. merged (mesh_id, vid, target)
    says for every vertex that went where it is now. A mesh of which no side may go any more stays above its budget.
    """
    now = scratch(faces.select("mesh_id", "fid", "v0", "v1", "v2"), "faces")
    points = scratch(vertex_quadrics(vertices, now), "quadrics")
    gone, done = None, 0
    while True:
        need = points.groupBy("mesh_id").agg(F.count("*").alias("n")).join(shuffled(budgets.select("mesh_id", "budget")), "mesh_id").where("n > budget").select("mesh_id", (F.col("n") - F.col("budget")).alias("need"))
        need = scratch(need, f"need-{done}")
        if need.isEmpty():
            break
        open_faces = now.join(shuffled(need), "mesh_id", "left_semi")
        sides = scratch(edges(open_faces).groupBy("mesh_id", "u", "v").agg(F.count("*").alias("n")), f"sides-{done}")
        within = lambda df, name: scratch(df, f"{name}-{done}")  # noqa: B023, E731
        some = scratch(collapses(points.join(shuffled(need), "mesh_id", "left_semi"), open_faces, sides, within), f"some-{done}")
        chosen = scratch(independent(some, sides), f"chosen-{done}")
        have = scratch(chosen.groupBy("mesh_id").agg(F.count("*").alias("have")).join(shuffled(need), "mesh_id"), f"have-{done}")
        found, over = have.agg(F.count("*"), F.count_if(F.col("have") > F.col("need"))).first()
        if not found:
            break
        if over:  # the last ones of a mesh: of what was chosen there, the cheapest
            order = Window.partitionBy("mesh_id").orderBy("cost", "u", "v")
            rest = chosen.join(shuffled(have.where("have > need")), "mesh_id").withColumn("k", F.row_number().over(order)).where("k <= need").select(chosen.columns)
            chosen = scratch(chosen.join(shuffled(have.where("have > need")), "mesh_id", "left_anti").unionByName(rest), f"taken-{done}")
        quadrics = points.select("mesh_id", F.col("vid").alias("v"), *[F.col(q).alias(f"v_{q}") for q in QUADRIC])
        into = chosen.join(shuffled(quadrics), ["mesh_id", "v"]).select("mesh_id", F.col("u").alias("vid"), *[F.col(c).alias(f"new_{c}") for c in "xyz"], *[f"v_{q}" for q in QUADRIC])
        left = points.join(shuffled(chosen.select("mesh_id", F.col("v").alias("vid"))), ["mesh_id", "vid"], "left_anti").join(shuffled(into), ["mesh_id", "vid"], "left")
        points = scratch(left.select("mesh_id", "vid", *[F.coalesce(f"new_{c}", c).alias(c) for c in "xyz"], *[(F.col(q) + F.coalesce(f"v_{q}", F.lit(0.0))).alias(q) for q in QUADRIC]), f"points-{done}")
        for k in range(3):
            now = now.join(shuffled(chosen.select("mesh_id", F.col("v").alias(f"v{k}"), F.col("u").alias("into"))), ["mesh_id", f"v{k}"], "left").withColumn(f"v{k}", F.coalesce("into", f"v{k}")).drop("into")
        now = scratch(now.where("v0 <> v1 AND v1 <> v2 AND v2 <> v0").select("mesh_id", "fid", "v0", "v1", "v2"), f"faces-{done}")
        step = chosen.select("mesh_id", F.col("v").alias("vid"), F.col("u").alias("target"))
        gone = step if gone is None else gone.unionByName(step)
        done += 1
    merged = pointed(gone, scratch) if gone is not None else vertices.select("mesh_id", "vid", F.col("vid").alias("target")).limit(0)
    return points.select("mesh_id", "vid", "x", "y", "z"), now, merged


def pointed(links: DataFrame, scratch) -> DataFrame:
    """(mesh_id, vid, target) with each target's own target followed to its end, by pointer jumping."""
    now, step = scratch(links, "target-0"), 0
    while True:
        ahead = now.select("mesh_id", F.col("vid").alias("target"), F.col("target").alias("further"))
        moved = now.join(shuffled(ahead), ["mesh_id", "target"], "left")
        step += 1
        moved = scratch(moved.select("mesh_id", "vid", F.coalesce("further", "target").alias("target"), F.col("further").isNotNull().alias("moved")), f"target-{step}")
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return now


# Relaxation.
def border_vertices(faces: DataFrame) -> DataFrame:
    """(mesh_id, vid) of the ends of sides with one face."""
    rim = edges(faces).groupBy("mesh_id", "u", "v").agg(F.count("*").alias("n")).where("n = 1")
    return rim.select("mesh_id", F.explode(F.array("u", "v")).alias("vid")).distinct()


def relaxed(vertices: DataFrame, faces: DataFrame, rounds: int, scratch, rate: float = 0.1, grow: float = 1.2) -> tuple[DataFrame, DataFrame]:
    """(vertices, steps): inner vertices moved so that all faces of a mesh come nearer to one area.

    What falls is the sum of (area - goal)^2 over a mesh's faces, the goal being its mean area at the
    start. Each round moves every inner vertex against its gradient, within the plane that its faces'
    normals give, which keeps it on a surface up to that plane. All meshes move at once, each by a
    step of its own: where the sum falls and no face turns over, the move is taken and the next step
    is greater by `grow`; elsewhere the mesh stays and its step is halved. Border vertices stay.
    steps: (mesh_id, round, energy, rate, taken), the sum before each round, and what became of it.
    """
    a, b, c = (g.vec(*(f"{p}{n}" for n in "xyz")) for p in "akc")
    normal = g.cross(g.sub(b, a), g.sub(c, a))
    size = g.norm(normal)
    corners = ((0, a, b, c), (1, b, c, a), (2, c, a, b))
    now = vertices.select("mesh_id", "vid", "x", "y", "z")
    inner = scratch(now.select("mesh_id", "vid").join(shuffled(border_vertices(faces)), ["mesh_id", "vid"], "left_anti").withColumn("free", F.lit(True)), "inner")
    named = lambda v, prefix: tuple(x.alias(f"{prefix}{n}") for x, n in zip(v, "xyz", strict=True))
    measured = lambda points: with_corners(faces, shuffled(points)).select("mesh_id", "fid", "v0", "v1", "v2", *named(a, "a"), *named(b, "k"), *named(c, "c"), (size / 2).alias("area"))
    start = measured(now).groupBy("mesh_id").agg(F.avg("area").alias("goal"))
    spread = F.pow(F.col("area") - F.col("goal"), F.lit(2.0))
    state = measured(now).join(shuffled(start), "mesh_id").groupBy("mesh_id").agg(F.sum(spread).alias("energy"), F.first("goal").alias("goal")).withColumn("rate", F.lit(rate))
    state, steps = scratch(state, "state-0"), []
    for k in range(rounds):
        unit = tuple(F.try_divide(x, size) for x in normal)
        pull = lambda p, q: g.scale(g.cross(unit, g.sub(q, p)), F.col("area") - F.col("goal"))  # noqa: B023, E731
        parts = F.explode(F.array(*[F.struct(F.col(f"v{i}").alias("vid"), *named(pull(p, q), "g"), *named(normal, "n")) for i, _, p, q in corners])).alias("e")
        sums = measured(now).join(shuffled(state.select("mesh_id", "goal")), "mesh_id").select("mesh_id", parts).select("mesh_id", "e.*").groupBy("mesh_id", "vid").agg(*[F.sum(f"{p}{n}").alias(f"{p}{n}") for p in "gn" for n in "xyz"])
        gradient, up = g.vec("gx", "gy", "gz"), g.vec("nx", "ny", "nz")
        along = F.coalesce(F.try_divide(g.dot(gradient, up), g.dot(up, up)), F.lit(0.0))
        both = now.join(shuffled(inner), ["mesh_id", "vid"], "left").join(shuffled(sums), ["mesh_id", "vid"], "left").join(shuffled(state.select("mesh_id", "rate")), "mesh_id", "left")
        moved = scratch(both.select("mesh_id", "vid", "x", "y", "z", *[F.coalesce(F.when(F.col("free"), F.col(n) - F.col("rate") * (s - along * u)), F.col(n)).alias(f"to_{n}") for n, s, u in zip("xyz", gradient, up, strict=True)]), f"moved-{k}")
        new = with_corners(faces, shuffled(moved.select("mesh_id", "vid", *[F.col(f"to_{n}").alias(n) for n in "xyz"]))).select("mesh_id", "fid", (size / 2).alias("area"), *named(normal, "m"))
        old = with_corners(faces, shuffled(moved)).select("mesh_id", "fid", *named(normal, "o"))
        judged = new.join(shuffled(old), ["mesh_id", "fid"]).join(shuffled(state.select("mesh_id", "goal")), "mesh_id").groupBy("mesh_id").agg(F.sum(spread).alias("then"), F.bool_or(g.dot(g.vec("mx", "my", "mz"), g.vec("ox", "oy", "oz")) <= 0).alias("over"))
        judged = scratch(state.join(shuffled(judged), "mesh_id").select("mesh_id", "goal", "energy", "rate", "then", ((F.col("then") < F.col("energy")) & ~F.col("over")).alias("taken")), f"judged-{k}")
        steps.append(judged.select("mesh_id", F.lit(k).alias("round"), "energy", "rate", "taken"))
        taken = moved.join(shuffled(judged.select("mesh_id", "taken")), "mesh_id", "left")
        now = scratch(taken.select("mesh_id", "vid", *[F.when(F.col("taken"), F.col(f"to_{n}")).otherwise(F.col(n)).alias(n) for n in "xyz"]), f"now-{k}")
        state = scratch(judged.select("mesh_id", "goal", F.when(F.col("taken"), F.col("then")).otherwise(F.col("energy")).alias("energy"), F.when(F.col("taken"), F.col("rate") * grow).otherwise(F.col("rate") / 2).alias("rate")), f"state-{k + 1}")
    every = steps[0] if steps else state.select("mesh_id", F.lit(0).alias("round"), "energy", "rate", F.lit(False).alias("taken")).limit(0)
    for more in steps[1:]:
        every = every.unionByName(more)
    return now, every
