"""Pixel operators on arrays: similarity of frames, panels by colour, rows and columns of ink. Kernels are numpy, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Least score of a match and least lead over the second; colour of a panel, its tolerance, and where it may be.
LEAST_SCORE, LEAST_LEAD = 0.72, 0.015
PANEL_RGB, PANEL_TOLERANCE, PANEL_LEFT, PANEL_TOP, PANEL_W, PANEL_H, PANEL_PIXELS, PANEL_FILL = (0x1A, 0x21, 0x29), 6, 220, 120, 40, 12, 240, 0.04
ZOOMS = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5)


def _centred(v: Column) -> Column:
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    return F.zip_with(v, F.array_repeat(mean, F.size(v)), lambda x, m: x - m)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def vector_matches(queries: DataFrame, candidates: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """JON-9, IMG-17 on vectors: query_id, source_id, score (Pearson) and mae of each query with the candidates of its group, itself left out.

    Vectors are centred and normalised once, before the join, so that a pair costs a product. Groups meet by an equi-join; AQE splits a large one.
    """

    def ready(d: DataFrame, name: str) -> DataFrame:
        v = F.transform(F.col(vector), lambda x: x.cast("double"))
        c = _centred(v)
        d = d.select(group, F.col(key).alias(f"{name}_id"), v.alias(f"{name}_v"), c.alias("c"))
        norm = F.sqrt(_dot(F.col("c"), F.col("c")))
        return d.withColumn("norm", norm).withColumn(f"{name}_u", F.when(F.col("norm") > 1e-9, F.transform("c", lambda x: x / F.col("norm")))).drop("c", "norm")

    pairs = ready(queries, "query").join(ready(candidates, "source"), group).filter(F.col("query_id") != F.col("source_id"))
    same = F.when(F.col("query_v") == F.col("source_v"), 1.0).otherwise(0.0)
    score = F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(F.col("query_u"), F.col("source_u")))), same)
    mae = F.aggregate(F.zip_with("query_v", "source_v", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, x: a + x) / F.size("query_v") / 255.0
    return pairs.select("query_id", "source_id", F.round(score, 9).alias("score"), F.round(mae, 9).alias("mae"))


def best_sources(matches: DataFrame) -> DataFrame:
    """WIN-6, IMG-18, SEQ-14: each query's best source by score, mae, id; it matches if its score is high and leads the second. Else the reason, and no id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "mae", "source_id")
    d = matches.withColumn("r", F.row_number().over(order)).withColumn("second", F.lead("score").over(order)).filter("r = 1")
    reason = F.when(F.col("score") < LEAST_SCORE, "score_below_threshold").when(F.col("score") - F.col("second") < LEAST_LEAD, "ambiguous_top_match").otherwise("")
    return d.withColumn("reason", reason).select("query_id", F.when(F.col("reason") == "", F.col("source_id")).alias("source_id"), "score", (F.col("reason") == "").alias("matched"), "reason")


def runs_of(mask: np.ndarray, fill: int = 0, least: int = 1) -> list[tuple[int, int]]:
    """WIN-8: (start, end) of runs of true values; gaps of up to fill are closed first, runs shorter than least left out."""
    m = np.concatenate([[0], np.asarray(mask, bool).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(m)).reshape(-1, 2)
    out: list[list[int]] = []
    for a, b in edges.tolist():
        if out and a - out[-1][1] <= fill:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if b - a >= least]


def gap_midpoints(runs: list[tuple[int, int]]) -> list[int]:
    """WIN-9."""
    return [(a[1] + b[0]) // 2 for a, b in zip(runs, runs[1:], strict=False)]


def find_panel(frame: np.ndarray) -> tuple[int, int, int, int] | None:
    """IMG-1 without components: the box (x, y, w, h) of pixels of the panel's colour near the corner, if there are enough."""
    if frame.ndim != 3 or frame.shape[-1] < 3:
        return None
    near = (np.abs(frame[..., :3].astype(np.int16) - np.array(PANEL_RGB)) <= PANEL_TOLERANCE).all(axis=-1)
    ys, xs = np.nonzero(near)
    if len(ys) < PANEL_PIXELS:
        return None
    x, y, w, h = int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1
    if x > PANEL_LEFT or y > PANEL_TOP or w < PANEL_W or h < PANEL_H or len(ys) / (w * h) < PANEL_FILL:
        return None
    return x, y, w, h


def to_gray(frame: np.ndarray) -> np.ndarray:
    """NUM-8."""
    a = np.asarray(frame)
    if a.ndim == 3:
        a = a[..., 0] * 0.299 + a[..., 1] * 0.587 + a[..., 2] * 0.114
    return np.clip(a, 0, 255).astype(np.uint8)


def text_rows(gray: np.ndarray, fill: int = 2, least: int = 4) -> list[tuple[int, int, int, int]]:
    """IMG-6, IMG-7 by projection: boxes (x, y, w, h) of rows of ink brighter than the middle of the 5th and 95th percentile."""
    g = np.asarray(gray, float)
    if not g.size:
        return []
    low, high = np.percentile(g, [5, 95])
    if high - low < 1e-6:
        return []
    ink = g > (low + high) / 2
    out = []
    for a, b in runs_of(ink.any(axis=1), fill, least):
        cols = np.flatnonzero(ink[a:b].any(axis=0))
        out.append((int(cols[0]), a, int(cols[-1] - cols[0] + 1), b - a))
    return out


def char_slices(line: np.ndarray, fill: int = 0) -> list[tuple[int, int]]:
    """IMG-12 by projection: (start, end) of the columns of each character of a line."""
    g = np.asarray(line, float)
    low, high = np.percentile(g, [5, 95]) if g.size else (0, 0)
    return runs_of((g > (low + high) / 2).any(axis=0), fill) if high > low else []


def zoom_scores(query: np.ndarray, frames: np.ndarray, zooms: tuple[float, ...] = ZOOMS) -> tuple[float, float, int, float]:
    """IMG-17: (score, mae, frame, zoom) of the frame and central crop most alike a query of the same size; of equals the least mae, then the first."""
    h, w = query.shape
    q = query.astype(np.float32).ravel()
    qc = q - q.mean()
    qn = float(np.linalg.norm(qc))
    best = (-2.0, 2.0, -1, 1.0)
    for z in zooms:
        ch, cw = max(1, round(h * z)), max(1, round(w * z))
        y = (h - ch) // 2 + np.clip(np.round(np.linspace(0, ch - 1, h)).astype(int), 0, ch - 1)
        x = (w - cw) // 2 + np.clip(np.round(np.linspace(0, cw - 1, w)).astype(int), 0, cw - 1)
        v = frames[:, y][:, :, x].reshape(len(frames), -1).astype(np.float32)
        c = v - v.mean(axis=1, keepdims=True)
        d = np.linalg.norm(c, axis=1) * qn
        s = np.where(d > 1e-9, c @ qc / np.maximum(d, 1e-9), (v == q).all(axis=1).astype(np.float32))
        mae = np.abs(v - q).mean(axis=1) / 255.0
        for i in np.lexsort((np.arange(len(s)), mae, -s))[:1]:
            if (s[i], -mae[i]) > (best[0], -best[1]):
                best = (float(s[i]), float(mae[i]), int(i), z)
    return best


def segment_frames(frames: DataFrame, key: str = "path") -> DataFrame:
    """IMG-1, IMG-7: key, frame_index, panel, rows and error of frames (height, width, channels, pixels as bytes). A bad frame is a row with its error."""
    box = "struct<x:int,y:int,w:int,h:int>"
    kind = frames.schema[key].dataType.simpleString()
    boxed = pa.struct([("x", pa.int32()), ("y", pa.int32()), ("w", pa.int32()), ("h", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda b: dict(zip("xywh", b, strict=True)) if b else None
        for batch in batches:
            panels, rows, errors = [], [], []
            for h, w, c, raw in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                panel, found, error = None, [], None
                try:
                    frame = np.frombuffer(raw, np.uint8).reshape((h, w, c) if c > 1 else (h, w))
                    panel = find_panel(frame)
                    x, y, bw, bh = panel or (0, 0, w, h)
                    found = [(a + x, b + y, p, q) for a, b, p, q in text_rows(to_gray(frame)[y : y + bh, x : x + bw])]
                except (ValueError, TypeError) as e:
                    error = f"{type(e).__name__}: {e}"
                panels.append(named(panel))
                rows.append([named(b) for b in found])
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(panels, boxed), pa.array(rows, pa.list_(boxed)), pa.array(errors, pa.string())], names=[key, "frame_index", "panel", "rows", "error"])

    return frames.select(key, "frame_index", "height", "width", "channels", "pixels").mapInArrow(run, f"{key} {kind}, frame_index int, panel {box}, rows array<{box}>, error string")


def order_alignment(a: list, b: list, score, skip: float = 0.0) -> list[tuple[int | None, int | None]]:
    """JON-18, SEQ-10: the pairs (place in a, place in b) of the best alignment that keeps both orders; places without partner have None."""
    n, m = len(a), len(b)
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    step = [[""] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            options = []
            if i and j:
                options.append((best[i - 1][j - 1] + score(a[i - 1], b[j - 1]), "both"))
            if i:
                options.append((best[i - 1][j] + skip, "a"))
            if j:
                options.append((best[i][j - 1] + skip, "b"))
            if options:
                best[i][j], step[i][j] = max(options, key=lambda o: o[0])
    out, i, j = [], n, m
    while i or j:
        s = step[i][j]
        i, j = i - (s != "b"), j - (s != "a")
        out.append((i if s != "b" else None, j if s != "a" else None))
    return out[::-1]


def rows_of_boxes(boxes: list[tuple[int, int, int, int]], gap: int = 2, by_centre: bool = True) -> list[list[tuple[int, int, int, int]]]:
    """WIN-10: boxes (x, y, w, h) in rows, from top to bottom: each joins the first row whose extent, widened by gap, holds its centre (or comes as near as gap to its own extent); else it begins one."""
    rows: list[list[tuple[int, int, int, int]]] = []
    extents: list[tuple[int, int]] = []
    for box in sorted((b for b in boxes if b[2] > 0 and b[3] > 0), key=lambda b: (b[1], b[0])):
        low, high = (box[1] + box[3] / 2,) * 2 if by_centre else (box[1], box[1] + box[3])
        at = next((i for i, (top, end) in enumerate(extents) if top - gap <= high and low <= end + gap), None)
        if at is None:
            rows.append([box])
            extents.append((box[1], box[1] + box[3]))
        else:
            rows[at].append(box)
            extents[at] = min(extents[at][0], box[1]), max(extents[at][1], box[1] + box[3])
    return rows
