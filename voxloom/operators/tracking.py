"""Detections and tracks over frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions import geometry as g
from voxloom.operators import spatial


def overlaps(detections: DataFrame, frame: str = "frame") -> DataFrame:
    """(frame, det_a, det_b, iou) of the pairs of a frame that overlap; an equi-join on the frame, a frame of many in blocks."""
    one = detections.select(frame, F.col("det_id").alias("det_a"), *[F.col(c).alias(f"a_{c}") for c in "ltrb"])
    two = detections.select(frame, F.col("det_id").alias("det_b"), *[F.col(c).alias(f"b_{c}") for c in "ltrb"])
    ratio = g.iou(g_rect("a"), g_rect("b"))
    return spatial.dealt(one, two, [frame]).where("det_a < det_b").select(frame, "det_a", "det_b", ratio.alias("iou")).where("iou > 0")


def best_overlaps(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """(frame, row_id, col_id, cost): of the overlapping pairs row < column, each row's and each column's least cost in each block.

    cost is 1 - iou, ties go to the least row, then column. The pairs themselves aren't kept.
    """

    def meet(a: dict, b: dict) -> dict:
        a, b = ({n: v[np.argsort(t["det_id"], kind="stable")] for n, v in t.items()} for t in (a, b))
        area = lambda t: (t["r"] - t["l"]) * (t["b"] - t["t"])
        of_column = np.full(len(b["det_id"]), np.inf)
        row = np.zeros(len(of_column), np.int64)
        found = []
        for at in range(0, len(a["det_id"]), 64):
            side = {n: v[at : at + 64, None] for n, v in a.items()}
            w = np.maximum(0.0, np.minimum(side["r"], b["r"]) - np.maximum(side["l"], b["l"]))
            h = np.maximum(0.0, np.minimum(side["b"], b["b"]) - np.maximum(side["t"], b["t"]))
            both = w * h
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = both / (area(side) + area(b) - both)
            cost = np.where((side["det_id"] < b["det_id"]) & (ratio > 0), 1 - ratio, np.inf)
            best = cost.argmin(1)
            found.append((side["det_id"][:, 0], b["det_id"][best], cost[np.arange(len(best)), best]))
            first = cost.argmin(0)
            least = cost[first, np.arange(len(row))]
            row = np.where(least < of_column, side["det_id"][first, 0], row)
            of_column = np.fmin(of_column, least)
        found.append((row, b["det_id"], of_column))
        row, column, cost = map(np.concatenate, zip(*found, strict=True))
        kept = cost < np.inf
        return {"frame": np.full(kept.sum(), a["frame"][0] if len(a["frame"]) else 0), "row_id": row[kept], "col_id": column[kept], "cost": cost[kept]}

    sides = [side.select("frame", "det_id", *"ltrb").dropna() for side in (rows, columns)]
    return spatial.paired(*sides, ["frame"], meet, "frame long, row_id long, col_id long, cost double")


def greedy_overlaps(detections: DataFrame, scratch) -> DataFrame:
    """greedy_assignment of a frame's overlapping detections, without a table or a group of its pairs: (frame, row_id, col_id, cost).

    A pair that is the least of its row and of its column is taken whatever else is; such pairs leave
    with their rows and columns, and the next round compares what is left. scratch(df, name) writes a table.
    """
    rows = columns = detections.select("frame", "det_id", *"ltrb")
    out, k = None, 0
    while True:
        best = scratch(best_overlaps(rows, columns), f"best{k}")
        pair = F.struct("cost", "row_id", "col_id")
        of_row = best.groupBy("frame", "row_id").agg(F.min(pair).alias("p")).select("frame", "p.*")
        of_column = best.groupBy("frame", "col_id").agg(F.min(pair).alias("p")).select("frame", "p.*")
        taken = scratch(of_row.join(of_column, ["frame", "cost", "row_id", "col_id"]), f"taken{k}")
        out = taken if out is None else out.unionByName(taken)
        if taken.isEmpty():
            return out
        # What overlaps nothing now won't do so later.
        open_ids = lambda name: best.select("frame", F.col(name).alias("det_id")).distinct().join(taken.select("frame", F.col(name).alias("det_id")), ["frame", "det_id"], "left_anti")  # noqa: B023, E731
        rows = scratch(rows.join(open_ids("row_id"), ["frame", "det_id"], "left_semi"), f"rows{k}")
        columns = scratch(columns.join(open_ids("col_id"), ["frame", "det_id"], "left_semi"), f"columns{k}")
        k += 1


def g_rect(prefix: str) -> tuple:
    return tuple(F.col(f"{prefix}_{c}") for c in "ltrb")


def greedy_assignment(costs: DataFrame, problem: str = "frame") -> DataFrame:
    """(problem, row_id, col_id, cost): the least cost of a problem is taken, its row and column leave, and so on.

    costs: (problem, row_id, col_id, cost); ties go to the least row, then column. A problem is one
    frame's matrix, small by nature, so each is one group.
    """
    def assign(pairs: pd.DataFrame) -> pd.DataFrame:
        rows, columns, keep = set(), set(), []
        for k, (r, c) in enumerate(zip(*(s := pairs.sort_values(["cost", "row_id", "col_id"], ignore_index=True))[["row_id", "col_id"]].to_numpy().T, strict=True)) if len(pairs) else []:
            if r not in rows and c not in columns:
                rows.add(r)
                columns.add(c)
                keep.append(k)
        return s.iloc[keep] if len(pairs) else pairs

    return costs.select(problem, "row_id", "col_id", "cost").groupBy(problem).applyInPandas(assign, f"{problem} long, row_id long, col_id long, cost double")


def trajectories(detections: DataFrame, until: int, track: str = "track", frame: str = "frame") -> DataFrame:
    """(track, n, path): each track's centres up to a frame, in the order of frames."""
    centre = F.struct(F.col(frame), F.col("det_id"), F.round((F.col("l") + F.col("r")) / 2, 3).alias("u"), F.round((F.col("t") + F.col("b")) / 2, 3).alias("v"))
    ordered = F.array_sort(F.collect_list(centre))
    return detections.where(F.col(frame) <= until).groupBy(track).agg(F.count("*").alias("n"), ordered.alias("path"))
