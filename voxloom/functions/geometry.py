"""Vector, matrix and predicate expressions as Columns; a vector is a tuple of three Columns.

Everything here stays within generated code: no UDFs. Angles are radians, x is right, y up, z forward.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


class Fields:
    """Named columns as a vector; the Columns are made when they are read, so that a module can hold one before there is a session."""

    def __init__(self, *names: str):
        self.names = names

    def __len__(self) -> int:
        return len(self.names)

    def __getitem__(self, k):
        return tuple(map(F.col, self.names[k])) if isinstance(k, slice) else F.col(self.names[k])

    def __iter__(self):
        return map(F.col, self.names)


def vec(*names: str) -> Fields:
    return Fields(*names)


def add(a: Vector, b: Vector) -> Vector:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def sub(a: Vector, b: Vector) -> Vector:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def scale(a: Vector, s) -> Vector:
    factors = s if isinstance(s, tuple) else (s, s, s)
    return tuple(p * q for p, q in zip(a, factors, strict=True))


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def squared(a: Vector, b: Vector) -> Column:
    d = sub(a, b)
    return dot(d, d)


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def rotate_x(p: Vector, angle) -> Vector:
    c, s = F.cos(angle), F.sin(angle)
    return (p[0], c * p[1] - s * p[2], s * p[1] + c * p[2])


def rotate_y(p: Vector, angle) -> Vector:
    c, s = F.cos(angle), F.sin(angle)
    return (c * p[0] + s * p[2], p[1], c * p[2] - s * p[0])


def rotate_z(p: Vector, angle) -> Vector:
    c, s = F.cos(angle), F.sin(angle)
    return (c * p[0] - s * p[1], s * p[0] + c * p[1], p[2])


def rotate(p: Vector, angles: Vector) -> Vector:
    """First about x, then y, then z."""
    return rotate_z(rotate_y(rotate_x(p, angles[0]), angles[1]), angles[2])


def rotate_back(p: Vector, angles: Vector, literal: bool = False) -> Vector:
    """The true inverse of rotate(); literal=True undoes x, y and z in that same order instead."""
    if literal:
        return rotate_z(rotate_y(rotate_x(p, -angles[0]), -angles[1]), -angles[2])
    return rotate_x(rotate_y(rotate_z(p, -angles[2]), -angles[1]), -angles[0])


def matmul(m, p: Vector) -> Vector:
    """A 3x3 matrix, rows of numbers or Columns, times a vector."""
    return tuple(row[0] * p[0] + row[1] * p[1] + row[2] * p[2] for row in m)


def transform4(m, p: Vector, divide: bool = True) -> Vector:
    """A 4x4 matrix times (p, 1); divide=False leaves the fourth coordinate aside."""
    x, y, z, w = (row[0] * p[0] + row[1] * p[1] + row[2] * p[2] + row[3] for row in m)
    return tuple(F.try_divide(c, w) for c in (x, y, z)) if divide else (x, y, z)


def mirror(p: Vector, axis: int) -> Vector:
    return tuple(-c if k == axis else c for k, c in enumerate(p))


def switch(p: Vector, i: int, j: int) -> Vector:
    out = list(p)
    out[i], out[j] = p[j], p[i]
    return tuple(out)


def from_scanner(p: Vector) -> Vector:
    """Scanner axes (forward, left, up) to ours (right, up, forward)."""
    return (-p[1], p[2], p[0])


def unproject(u: Column, v: Column, depth: Column, fu: float, fv: float, cu: float, cv: float) -> Vector:
    """Pinhole un-projection of a pixel's centre."""
    return ((u + 0.5 - cu) / fu * depth, (v + 0.5 - cv) / fv * depth, depth)


def to_grid(p: Vector, centre: Vector, angle: Column, size: Column, padding: float, shape: tuple[int, int, int]) -> Vector:
    """Box-centred, turned back, scaled so that the padded box spans the grid's width; shape is (H, W, D)."""
    h, w, d = shape
    q = scale(rotate_y(sub(p, centre), -angle), F.lit(float(w)) / (size * (1 + 2 * padding)))
    return add(q, (F.lit(w / 2), F.lit(h / 2), F.lit(d / 2)))


def canonical(p: Vector, size: Vector, translation: Vector, yaw: Column, width: int) -> Vector:
    """A point in its box's frame, in units in which the box is `width` long."""
    return scale(rotate_y(sub(p, translation), yaw), F.lit(float(width)) / size[0])


def pose_of(yaw: Column, translation: Vector, s) -> list[list[Column]]:
    """4x4 pose of a yaw, a translation and a scale."""
    c, n, zero, one = F.cos(yaw) * s, F.sin(yaw) * s, F.lit(0.0), F.lit(1.0)
    return [[c, zero, n, translation[0]], [zero, F.lit(1.0) * s, zero, translation[1]], [-n, zero, c, translation[2]], [zero, zero, zero, one]]


def intrinsics(fx, fy, px, py, skew=0.0) -> list[list[Column]]:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return [[lit(fx), lit(skew), lit(px)], [lit(0), lit(fy), lit(py)], [lit(0), lit(0), lit(1)]]


def look_at(target: Vector, eye: Vector, up: Vector) -> list[list[Column]]:
    """View matrix of an eye that looks at a target."""
    f = sub(target, eye)
    f = scale(f, F.lit(1.0) / norm(f))
    u = scale(up, F.lit(1.0) / norm(up))
    s = cross(f, u)
    w = cross(s, f)
    rows = [list(s), list(w), [-c for c in f]]
    return [[*r, -(r[0] * eye[0] + r[1] * eye[1] + r[2] * eye[2])] for r in rows] + [[F.lit(0.0)] * 3 + [F.lit(1.0)]]


def plane_alignment(plane: tuple) -> list[list[Column]]:
    """Rotation that takes a plane's normal (a, b, c) to (0, -1, 0), and the shift by -d; by Rodrigues' formula."""
    a, b, c, d = plane
    v = (c, F.lit(0.0) * a, -a)  # normal x (0, -1, 0)
    cosine, sine2 = -b, a * a + c * c
    k = (1 - cosine) / sine2
    skew = [[F.lit(0.0), -v[2], v[1]], [v[2], F.lit(0.0), -v[0]], [-v[1], v[0], F.lit(0.0)]]
    square = [[sum(skew[i][m] * skew[m][j] for m in range(3)) for j in range(3)] for i in range(3)]
    turned = [[(1.0 if i == j else 0.0) + skew[i][j] + square[i][j] * k for j in range(3)] for i in range(3)]
    return [[*turned[0], F.lit(0.0)], [*turned[1], -d], [*turned[2], F.lit(0.0)], [F.lit(0.0)] * 3 + [F.lit(1.0)]]


def disparity_to_depth(disparity: Column, baseline: float, focal: float) -> Column:
    """Null outside 1 to 1000; disparities are in 1/256 pixel."""
    z = F.try_divide(F.lit(baseline * focal), disparity / 256.0)
    return F.when(z.between(1, 1000), z)


def depth_to_disparity(z: Column, baseline: float, focal: float) -> Column:
    """In whole 1/256 pixels, cut off; null outside 1 to 1000."""
    return F.when(z.between(1, 1000), F.floor(F.lit(baseline * focal) / z * 256).cast("int"))


def height_at(plane: tuple, x: Column, z: Column) -> Column:
    a, b, c, d = plane
    return (-d - c * z - a * x) / b


def wrap_angle(value: Column, low: float, high: float) -> Column:
    """Into [low, high), both ends being the same place."""
    return F.pmod(value - low, F.lit(float(high - low))) + low


def bounce_angle(value: Column, low: float, high: float) -> Column:
    """Reflected at low and high, for ranges symmetric about 0 or from 0."""
    span = abs(low) + abs(high)
    turned = F.when(value < -span, value + F.ceil(value / (-2.0 * span)) * (2.0 * span)).when(value > span, value - F.floor(value / (2.0 * span)) * (2.0 * span)).otherwise(value)
    upper = F.when(turned > high, span - turned).otherwise(turned)
    return F.when(upper < low, -span - upper).otherwise(upper)


def jet(value: Column) -> Vector:
    """Red, green and blue of a value from -1 to 1."""
    def ramp(v: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.5 - 2 * F.abs(v)))

    return (ramp(value - 0.5), ramp(value), ramp(value + 0.5))


#: The palette for ids, by the id's last digit.
PALETTE = [(240, 62, 36), (245, 116, 32), (251, 174, 24), (213, 223, 38), (153, 204, 112), (136, 201, 141), (124, 201, 169), (100, 199, 230), (64, 120, 188), (61, 88, 167)]


def palette_colour(number: Column) -> Column:
    colours = F.array(*[F.array(*[F.lit(c) for c in rgb]) for rgb in PALETTE])
    return F.get(colours, F.pmod(number, F.lit(len(PALETTE))).cast("int"))


def within(p: Vector, low: Vector, high: Vector) -> Column:
    """Closed on all faces."""
    return p[0].between(low[0], high[0]) & p[1].between(low[1], high[1]) & p[2].between(low[2], high[2])


def in_oriented_box(p: Vector, size: Vector, translation: Vector, yaw: Column) -> Column:
    q = rotate_y(sub(p, translation), yaw)
    return (F.abs(q[0]) <= size[0] / 2) & (F.abs(q[1]) <= size[1] / 2) & (F.abs(q[2]) <= size[2] / 2)


def slab_interval(origin: Vector, direction: Vector, low: Vector, high: Vector) -> tuple[Column, Column]:
    """The ray's parameters at which it enters and leaves an axis-aligned box; an axis without motion is free inside and empty outside."""
    enter, leave = [], []
    for o, d, lo, hi in zip(origin, direction, low, high, strict=True):
        still = d == 0
        inside = (o >= lo) & (o <= hi)
        a, b = F.try_divide(lo - o, d), F.try_divide(hi - o, d)
        enter.append(F.when(still, F.when(inside, F.lit(-math.inf)).otherwise(F.lit(math.inf))).otherwise(F.least(a, b)))
        leave.append(F.when(still, F.when(inside, F.lit(math.inf)).otherwise(F.lit(-math.inf))).otherwise(F.greatest(a, b)))
    return F.greatest(*enter), F.least(*leave)


def ray_hits_box(origin: Vector, direction: Vector, low: Vector, high: Vector, t0: float = 0.0, t1: float = 1.0) -> Column:
    near, far = slab_interval(origin, direction, low, high)
    return (near <= far) & (near < t1) & (far > t0)


def ray_triangle(origin: Vector, direction: Vector, a: Vector, b: Vector, c: Vector, eps: float = 1e-6) -> Column:
    """Parameter of the hit, or null (Moller-Trumbore, both sides)."""
    e1, e2 = sub(b, a), sub(c, a)
    p = cross(direction, e2)
    det = dot(e1, p)
    s = sub(origin, a)
    q = cross(s, e1)
    u, v, t = F.try_divide(dot(s, p), det), F.try_divide(dot(direction, q), det), F.try_divide(dot(e2, q), det)
    return F.when((F.abs(det) > eps) & (u >= 0) & (u <= 1) & (v >= 0) & (u + v <= 1), t)


def triangle_overlaps_box(centre: Vector, half: Vector, a: Vector, b: Vector, c: Vector) -> Column:
    """Separating axes: the box's three, the triangle's normal, and the nine products of edges.

    The corners are bound once, as the element of an array that a lambda reads: written out, the
    thirteen tests over their formulas would be too long for generated code.
    """
    names = [f"{k}{axis}" for k in range(3) for axis in "xyz"]
    bound = F.struct(*[v.alias(n) for n, v in zip(names, [v for x in (a, b, c) for v in sub(x, centre)], strict=True)], *[h.alias(f"h{axis}") for axis, h in zip("xyz", half, strict=True)])
    return F.get(F.transform(F.array(bound), _overlaps), 0)


def _overlaps(t: Column) -> Column:
    corners = [tuple(t[f"{k}{axis}"] for axis in "xyz") for k in range(3)]
    half = tuple(t[f"h{axis}"] for axis in "xyz")
    edges = [sub(corners[1], corners[0]), sub(corners[2], corners[1]), sub(corners[0], corners[2])]
    meets = None

    def also(condition: Column) -> None:
        nonlocal meets
        meets = condition if meets is None else meets & condition

    for k in range(3):
        also((F.least(*[x[k] for x in corners]) <= half[k]) & (F.greatest(*[x[k] for x in corners]) >= -half[k]))
    for m, e in enumerate(edges):
        one, other = corners[m], corners[(m + 2) % 3]  # both ends of an edge project to the same number
        for k in range(3):
            i, j = (k + 1) % 3, (k + 2) % 3  # unit axis k x e = (0, -e_j, e_i) in axes (k, i, j)
            p, q = one[j] * e[i] - one[i] * e[j], other[j] * e[i] - other[i] * e[j]
            radius = half[i] * F.abs(e[j]) + half[j] * F.abs(e[i])
            also(F.abs(p + q) <= 2 * radius + F.abs(p - q))
    n = cross(edges[0], edges[1])
    reach = half[0] * F.abs(n[0]) + half[1] * F.abs(n[1]) + half[2] * F.abs(n[2])
    also(F.abs(dot(n, corners[0])) <= reach)
    return meets


def point_in_triangle_2d(p: tuple, a: tuple, b: tuple, c: tuple) -> Column:
    """Strictly consistent orientation, ties broken by the coordinates, so that shared edges belong to one triangle."""
    q = [(x[0] - p[0], x[1] - p[1]) for x in (a, b, c)]

    def side(s: tuple, t: tuple) -> Column:
        area = s[1] * t[0] - s[0] * t[1]
        tie = F.when(t[1] > s[1], 1).when(t[1] < s[1], -1).when(s[0] > t[0], 1).when(s[0] < t[0], -1).otherwise(0)
        return F.when(area > 0, 1).when(area < 0, -1).otherwise(tie)

    s1, s2, s3 = side(q[1], q[2]), side(q[2], q[0]), side(q[0], q[1])
    return (s1 != 0) & (s1 == s2) & (s1 == s3)


def triangle_area(a: Vector, b: Vector, c: Vector) -> Column:
    return norm(cross(sub(b, a), sub(c, a))) / 2


def point_triangle_distance(p: Vector, a: Vector, b: Vector, c: Vector) -> Column:
    """To the nearest point of the triangle: its plane if that lies inside, else the nearest edge."""
    def to_edge(s: Vector, t: Vector) -> Column:
        d = sub(t, s)
        k = F.coalesce(F.try_divide(dot(sub(p, s), d), dot(d, d)), F.lit(0.0))
        return squared(p, add(s, scale(d, F.greatest(F.lit(0.0), F.least(F.lit(1.0), k)))))

    ab, ac, ap = sub(b, a), sub(c, a), sub(p, a)
    d00, d01, d11, d20, d21 = dot(ab, ab), dot(ab, ac), dot(ac, ac), dot(ap, ab), dot(ap, ac)
    det = d00 * d11 - d01 * d01
    v, w = F.try_divide(d11 * d20 - d01 * d21, det), F.try_divide(d00 * d21 - d01 * d20, det)
    n = cross(ab, ac)
    flat = F.try_divide(dot(ap, n) * dot(ap, n), dot(n, n))
    inside = (v >= 0) & (w >= 0) & (v + w <= 1)
    return F.sqrt(F.when(inside, flat).otherwise(F.least(to_edge(a, b), to_edge(b, c), to_edge(c, a))))


def iou(a: tuple, b: tuple) -> Column:
    """Intersection over union of rectangles (left, top, right, bottom)."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    both = w * h
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


def normal_angles(ray: Vector) -> Vector:
    """Angles between each axis and the ray's projection without that axis, as they turn a ray."""
    out = []
    for k in range(3):
        rest = [F.lit(0.0) if m == k else ray[m] for m in range(3)]
        length = F.sqrt(rest[0] * rest[0] + rest[1] * rest[1] + rest[2] * rest[2])
        out.append(F.acos(F.try_divide(rest[k], length)))
    return tuple(out)


def determinant3(m) -> Column:
    return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])


def inverse3(m) -> list[list[Column]]:
    """By cofactors; null where the determinant is 0."""
    det = determinant3(m)
    def cofactor(i: int, j: int) -> Column:
        r, c = [k for k in range(3) if k != j], [k for k in range(3) if k != i]
        minor = m[r[0]][c[0]] * m[r[1]][c[1]] - m[r[0]][c[1]] * m[r[1]][c[0]]
        return F.try_divide(minor if (i + j) % 2 == 0 else -minor, det)

    return [[cofactor(i, j) for j in range(3)] for i in range(3)]


def transform_plane(m, plane: tuple) -> tuple:
    """Plane (a, b, c, d) of n x + d = 0 after an affine 4x4 matrix: the normal goes by the inverse transpose and isn't made a unit vector; null where the matrix is singular."""
    inverse = inverse3([[F.lit(float(v)) for v in row[:3]] for row in m[:3]])
    n = matmul(list(zip(*inverse, strict=True)), plane[:3])
    return (*n, plane[3] - dot(n, tuple(F.lit(float(row[3])) for row in m[:3])))
