"""Iterative fits: rigid alignment and shape models. Each group is one small problem, solved in numpy in its own task."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RIGID = ", ".join([*(f"r{i}{j} double" for i in range(3) for j in range(3)), *(f"t{i} double" for i in range(3)), "residual double", "inliers long", "steps long"])


def kabsch(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and shift that take p to q with the least squares; never a reflection."""
    cp, cq = p.mean(0), q.mean(0)
    u, _, v = np.linalg.svd((p - cp).T @ (q - cq))
    d = np.diag([1.0, 1.0, np.sign(np.linalg.det(v.T @ u.T)) or 1.0])
    r = v.T @ d @ u.T
    return r, cq - r @ cp


def nearest_of(points: np.ndarray, target: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each point's nearest target; in blocks, so that memory stays bounded."""
    index, best = np.empty(len(points), np.int64), np.empty(len(points))
    for at in range(0, len(points), block):
        d = ((points[at : at + block, None] - target[None]) ** 2).sum(2)
        index[at : at + block] = d.argmin(1)
        best[at : at + block] = d.min(1)
    return index, best


def align(template: np.ndarray, model: np.ndarray, plane: bool = False, most: int = 1000, radius: float = 54.0, shrink: float = 0.9, floor: float = 0.05, enough: float = 1e-4) -> dict:
    """Iterative closest points from template to model.

    The inlier radius shrinks each step and is compared with squared distances; the mean squared
    residual of the inliers ends the run. plane=True measures along the model's normals.
    """
    n = min(len(template), len(model))
    r, t = np.eye(3), (model[:n] - template[:n]).mean(0) if n else np.zeros(3)
    residual, inliers, step = np.inf, 0, 0
    if n < 5:
        return {"r": r, "t": t, "residual": None, "inliers": 0, "steps": 0}
    normals = surface_normals(model) if plane else None
    while step < most:
        step += 1
        moved = template @ r.T + t
        index, d2 = nearest_of(moved, model)
        close = d2 < radius
        if close.sum() < 5:
            break
        p, q = moved[close], model[index[close]]
        if plane:
            m = normals[index[close]]
            a = np.concatenate([np.cross(p, m), m], 1)
            x = np.linalg.lstsq(a, ((q - p) * m).sum(1), rcond=None)[0]
            u, _, v = np.linalg.svd(np.eye(3) + np.array([[0, -x[2], x[1]], [x[2], 0, -x[0]], [-x[1], x[0], 0]]))
            dr, dt = u @ v, x[3:]
        else:
            dr, dt = kabsch(p, q)
        r, t = dr @ r, dr @ t + dt
        _, d2 = nearest_of(template @ r.T + t, model)
        close = d2 < radius
        residual, inliers = float(d2[close].mean()) if close.any() else np.inf, int(close.sum())
        if residual <= enough:
            break
        radius = max(floor, radius * shrink)
    return {"r": r, "t": t, "residual": residual if np.isfinite(residual) else None, "inliers": inliers, "steps": step}


def surface_normals(points: np.ndarray, neighbours: int = 10) -> np.ndarray:
    out = np.empty_like(points)
    k = min(neighbours, len(points))
    for i, p in enumerate(points):
        near = points[np.argpartition(((points - p) ** 2).sum(1), k - 1)[:k]]
        out[i] = np.linalg.svd(near - near.mean(0))[2][2]
    return out


def alignments(pairs: DataFrame, plane: bool = False) -> DataFrame:
    """For each pair_id, the rigid motion from its template to its model.

    pairs: (pair_id, side, x, y, z) with side 'template' or 'model'; the two clouds of a pair are one object and so small.
    """
    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "x", "y", "z"]) if "point_id" not in rows else rows.sort_values(["side", "point_id"])
        sides = [rows.loc[rows["side"] == s, ["x", "y", "z"]].to_numpy(float) for s in ("template", "model")]
        m = align(*sides, plane=plane)
        values = [*m["r"].ravel().tolist(), *m["t"].tolist(), m["residual"], m["inliers"], m["steps"]]
        return pd.DataFrame([[key[0], *values]], columns=["pair_id", *(c.split()[0] for c in RIGID.split(", "))])

    return pairs.groupBy("pair_id").applyInPandas(one, f"pair_id long, {RIGID}")


def accepted(fits: DataFrame, sizes: DataFrame, most: float = 0.001) -> DataFrame:
    """Fits whose residual is small and that at least half of the template's points support."""
    return fits.join(sizes, "pair_id").where((F.col("residual") < most) & (F.col("inliers") >= F.floor(F.col("n") / 2)))


def accumulated(clouds: DataFrame, fits: DataFrame) -> DataFrame:
    """Template points moved into the model's frame and put beside the model's points: (pair_id, side, x, y, z)."""
    moved = clouds.where("side = 'template'").join(fits, "pair_id")
    at = [F.col(f"r{i}0") * F.col("x") + F.col(f"r{i}1") * F.col("y") + F.col(f"r{i}2") * F.col("z") + F.col(f"t{i}") for i in range(3)]
    return clouds.where("side = 'model'").select("pair_id", "side", "x", "y", "z").unionByName(moved.select("pair_id", "side", *[a.alias(c) for a, c in zip(at, "xyz", strict=True)]))


def fit_shape(points: np.ndarray, mean: np.ndarray, basis: np.ndarray, shape: tuple[int, int, int], deviations: np.ndarray, pose: bool = True, rounds: int = 30, most: int = 100, huber: float = 0.1) -> dict:
    """Code z (and shift and yaw) so that the points lie on the zero level of mean + basis z, by damped Gauss-Newton steps.

    The field is on a grid (unit cells, first axis y); points outside cost a constant. Shape and pose
    alternate until the cost falls by at most 0.1 %.
    """
    z, yaw, shift = np.zeros(basis.shape[1]), 0.0, np.zeros(3)

    def moved(yaw: float, shift: np.ndarray) -> np.ndarray:
        c, s = np.cos(yaw), np.sin(yaw)
        return points @ np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]]).T + shift

    def corners(p: np.ndarray):
        q = p[:, [1, 0, 2]]
        low = np.floor(q).astype(int)
        inside = ((low >= 0) & (low + 1 < np.array(shape))).all(1)
        low = np.where(inside[:, None], low, 0)
        f = q - low
        index, weight = [], []
        for k in range(8):
            b = np.array([(k >> 2) & 1, (k >> 1) & 1, k & 1])
            index.append(np.ravel_multi_index((low + b).T, shape))
            weight.append(np.prod(np.where(b, f, 1 - f), 1))
        return np.stack(index, 1), np.stack(weight, 1), inside

    def residuals(z: np.ndarray, yaw: float, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        index, weight, inside = corners(moved(yaw, shift))
        value = (weight * (mean + basis @ z)[index]).sum(1)
        jac = np.einsum("nk,nkr->nr", weight, basis[index])
        return np.where(inside, value, 3.0), jac * inside[:, None]

    def cost(r: np.ndarray, z: np.ndarray) -> float:
        a = np.abs(r)
        return float(np.where(a <= huber, r**2 / 2, huber * (a - huber / 2)).sum() / (0.03 * len(r)) + ((z / deviations) ** 2).sum() / 2)

    r, _ = residuals(z, yaw, shift)
    now, steps = cost(r, z), 0
    for _ in range(rounds):
        before = now
        damping = 1e-3
        for _ in range(most):
            r, jac = residuals(z, yaw, shift)
            w = np.where(np.abs(r) <= huber, 1.0, huber / np.maximum(np.abs(r), 1e-12)) / (0.03 * len(r))
            a = (jac * w[:, None]).T @ jac + np.diag(1 / deviations**2)
            step = np.linalg.solve(a + damping * np.diag(np.diag(a)), -(jac.T @ (w * r) + z / deviations**2))
            new = cost(residuals(z + step, yaw, shift)[0], z + step)
            steps += 1
            if new < now:
                z, gain, now, damping = z + step, now - new, new, damping / 3
                if gain < 1e-6 * max(now, 1e-12):
                    break
            else:
                damping *= 5
                if damping > 1e6:
                    break
        if pose:
            for size in (0.5, 0.1, 0.02):
                better = True
                while better:
                    better = False
                    for k in range(4):
                        for sign in (1, -1):
                            dy, ds = (sign * size * 0.1, np.zeros(3)) if k == 3 else (0.0, sign * size * np.eye(3)[k])
                            new = cost(residuals(z, yaw + dy, shift + ds)[0], z)
                            if new < now - 1e-9:
                                yaw, shift, now, better = yaw + dy, shift + ds, new, True
        if before - now <= 1e-3 * max(before, 1e-12):
            break
    return {"z": z, "yaw": yaw, "shift": shift, "cost": now, "steps": steps}


def shape_fits(clouds: DataFrame, mean: list[float], basis: list[list[float]], shape: tuple[int, int, int], deviations: list[float], pose: bool = True) -> DataFrame:
    """(cloud_id, z, yaw, shift, cost): a shape model of fixed size fitted to each cloud."""
    m, b, s = np.asarray(mean, float), np.asarray(basis, float), np.asarray(deviations, float)

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p = rows.sort_values(["x", "y", "z"])[["x", "y", "z"]].to_numpy(float)
        f = fit_shape(p, m, b, shape, s, pose)
        return pd.DataFrame([{"cloud_id": key[0], "z": f["z"].tolist(), "yaw": f["yaw"], "shift": f["shift"].tolist(), "cost": f["cost"]}])

    return clouds.select("cloud_id", "x", "y", "z").groupBy("cloud_id").applyInPandas(one, "cloud_id long, z array<double>, yaw double, shift array<double>, cost double")


def surface(volume: DataFrame, shape: tuple[int, int, int], level: float = 0.0) -> DataFrame:
    """(sample_id, x0..z2): triangles of the level set, from tetrahedra.

    Each cell is cut into six tetrahedra along its diagonal; a tetrahedron whose corners lie on both
    sides gives one triangle or two, by linear interpolation on its sides. No case table is needed.
    """
    paths = [(1, 3), (1, 5), (2, 3), (2, 6), (4, 5), (4, 6)]
    bits = np.array([[(k >> 2) & 1, (k >> 1) & 1, k & 1] for k in range(8)])

    base = np.stack(np.meshgrid(*[np.arange(n - 1) for n in shape], indexing="ij"), -1).reshape(-1, 3)
    tets = np.concatenate([base[:, None] + bits[[0, a, b, 7]][None] for a, b in paths])
    flat_index = np.ravel_multi_index(tuple(tets[..., k] for k in range(3)), shape)
    names = [f"{p}{c}" for p in "akc" for c in "xyz"]

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        grid = np.full(shape, np.nan)
        grid[tuple(rows[c].to_numpy().astype(int) for c in ("h", "w", "d"))] = rows["value"].to_numpy()
        value = grid.ravel()[flat_index] - level
        below = value < 0
        n = below.sum(1)
        whole = ~np.isnan(value).any(1)
        out = []

        def cut(tet: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            k = np.arange(len(v))
            return tet[k, i] + (tet[k, j] - tet[k, i]) * (v[k, i] / (v[k, i] - v[k, j]))[:, None]

        for count in (1, 2, 3):
            some = whole & (n == count)
            tet, v = tets[some], value[some]
            order = np.argsort(~below[some], axis=1, kind="stable")  # the corners below first, each kind in its order
            if count == 2:
                q = [cut(tet, v, order[:, i], order[:, j]) for i, j in ((0, 2), (0, 3), (1, 3), (1, 2))]
                out += [np.stack([q[0], q[1], q[2]], 1), np.stack([q[0], q[2], q[3]], 1)]
            else:
                lone, rest = (0, (1, 2, 3)) if count == 1 else (3, (0, 1, 2))
                out.append(np.stack([cut(tet, v, order[:, lone], order[:, k]) for k in rest], 1))
        flat = np.concatenate(out)[:, :, [1, 0, 2]].reshape(-1, 9)
        return pa.table({"sample_id": pa.repeat(key[0], len(flat))} | {name: flat[:, k] for k, name in enumerate(names)})

    return volume.select("sample_id", "h", "w", "d", "value").groupBy("sample_id").applyInArrow(one, "sample_id long, " + ", ".join(f"{p}{c} double" for p in "akc" for c in "xyz"))
