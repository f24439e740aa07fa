"""Faces followed through a video by the clock of its frames: boxes go to tracks, tracks go on where no box is seen.

At every frame each track predicts its box, by a Kalman filter of centre, size and their
speeds. Tracks choose in the order in which they began: the free box that overlaps the prediction most,
the first of equal ones, from FACE_IOU on. A track that finds none goes on with its
prediction and grows older by one; at FACE_AGE it ends. Boxes that are left begin tracks.

Over frames without boxes a state moves at once, by a power of the matrix that moves it.
Where more than FACE_AGE frames lie between two frames with boxes no track is left: what follows is
a part of its own, so parts of one video are worked on in different tasks, and a task holds
one part. All tracks of a frame move at once, as rows of arrays; only the choice goes from track to track.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import dealt

FACE_IOU, FACE_AGE = 0.3, 10
MOVE_NOISE, SEEN_NOISE, FIRST_SPREAD = 0.03, 0.5, 0.1

CELLS = 1 << 16  # pairs of a track and a box that are compared at once

_RESULT = "video long, part long, frame int, track long, id long, age int, x1 int, y1 int, x2 int, y2 int"


def boxes_of(centre: np.ndarray, size: tuple[int, int] | None) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number corners of centres and sizes, cut to the picture if its size is given; and which of them have anything left."""
    half = centre[:, 2:] / 2
    box = np.trunc(np.hstack((centre[:, :2] - half, centre[:, :2] + half)))
    there = (centre[:, 2:] > 0).all(axis=1)
    if size is not None:
        box = np.clip(box, 0, np.array((*size, *size)) - 1.0)
        there &= (box[:, 2:] > box[:, :2]).all(axis=1)
    return box, there


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared area of boxes (corners) by their common area: a row for each of a, a column for each of b, which have an area."""
    sides = []
    for k in (0, 1):
        side = np.minimum(a[:, None, k + 2], b[None, :, k + 2])
        side -= np.maximum(a[:, None, k], b[None, :, k])
        sides.append(np.maximum(side, 0, out=side))
    shared, union = np.multiply(*sides, out=sides[0]), sides[1]
    np.add(_area(a)[:, None], _area(b)[None, :], out=union)
    union -= shared
    return np.divide(shared, union, out=shared)


def _area(box: np.ndarray) -> np.ndarray:
    return (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])


def chosen(guess: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """For each guess, in order, the free box that overlaps it most, the first of equal ones, from FACE_IOU on; -1: none. Only free boxes are compared."""
    out, left, at = np.full(len(guess), -1), np.arange(len(boxes)), 0
    while at < len(guess) and len(left):
        score = overlaps(guess[at : at + max(1, CELLS // len(left))], boxes[left])
        free = np.ones(len(left), bool)
        best = score.argmax(axis=1)
        for i in np.flatnonzero(score[np.arange(len(score)), best] >= FACE_IOU):
            k = best[i] if free[best[i]] else np.where(free, score[i], 0).argmax()
            if free[k] and score[i, k] >= FACE_IOU:
                out[at + i], free[k] = left[k], False
        left, at = left[free], at + len(score)
    return out


class Tracks:
    """All tracks of a frame, a row for each. Centre and size have the same noise and don't mix, so the spread of a place and its speed (2 x 2) is one for all four."""

    def __init__(self):
        self.number, self.age, self.box = np.zeros(0, int), np.zeros(0, int), np.zeros((0, 4))
        self.place, self.speed, self.spread = np.zeros((0, 4)), np.zeros((0, 4)), np.zeros((4, 0))

    def begin(self, first: int, boxes: np.ndarray) -> None:
        n = len(boxes)
        self.number, self.age = np.append(self.number, first + np.arange(n)), np.append(self.age, np.zeros(n, int))
        self.box, self.place, self.speed = np.vstack((self.box, boxes)), np.vstack((self.place, self.centre(boxes))), np.vstack((self.speed, np.zeros((n, 4))))
        self.spread = np.hstack((self.spread, np.outer((FIRST_SPREAD, 0, 0, FIRST_SPREAD), np.ones(n))))

    def end(self) -> None:
        on = self.age < FACE_AGE
        self.number, self.age, self.box, self.place, self.speed, self.spread = self.number[on], self.age[on], self.box[on], self.place[on], self.speed[on], self.spread[:, on]

    @staticmethod
    def centre(box: np.ndarray) -> np.ndarray:
        return np.hstack(((box[:, :2] + box[:, 2:]) / 2, box[:, 2:] - box[:, :2]))

    def move(self, k: int) -> None:
        """k frames on: the move's k-th power is 1 + k * speed, and the noise adds up along it."""
        ones, squares = k * (k - 1) / 2, (k - 1) * k * (2 * k - 1) / 6
        self.place = self.place + k * self.speed
        p, q, r, s = self.spread
        p, q = p + k * r, q + k * s
        self.spread = np.stack((p + q * k, q, r + s * k, s)) + MOVE_NOISE * np.array([[k + squares], [ones], [ones], [k]])

    def correct(self, rows: np.ndarray, boxes: np.ndarray) -> None:
        p, q, r, s = self.spread[:, rows]
        sure = 1 / (p + SEEN_NOISE)
        near, fast = p * sure, r * sure
        off = self.centre(boxes) - self.place[rows]
        self.place[rows] += near[:, None] * off
        self.speed[rows] += fast[:, None] * off
        self.spread[:, rows] = (1 - near) * p, (1 - near) * q, r - fast * p, s - fast * q


def follow(frame: np.ndarray, boxes: np.ndarray, size: tuple[int, int] | None) -> list[tuple[np.ndarray, ...]]:
    """Arrays (frame, track, row of the box taken or -1, age, box) from boxes (corners) in the order of their frames."""
    t, out, total, last = Tracks(), [], 0, None

    def told(at: int, rows: np.ndarray, taken: np.ndarray) -> None:
        out.append((np.full(len(rows), at), t.number[rows], taken, t.age[rows], t.box[rows]))

    def unseen(first: int, count: int) -> None:
        """Frames without boxes: all tracks go on with their predictions."""
        for j in range(min(count, FACE_AGE - 1)):
            t.age += 1
            box, there = boxes_of(t.place + (j + 1) * t.speed, size)
            on = t.age < FACE_AGE
            t.box[on & there] = box[on & there]
            told(first + j, np.flatnonzero(on), np.full(on.sum(), -1))
        t.age += count - min(count, FACE_AGE - 1)
        t.move(count)
        t.end()

    edges = np.flatnonzero(np.diff(frame, prepend=frame[0] - 1, append=frame[-1] + 1)) if len(frame) else []
    for start, end in zip(edges[:-1], edges[1:]):
        now, here = int(frame[start]), boxes[start:end]
        if last is not None and now - last > 1:
            unseen(last + 1, now - last - 1)
        t.move(1)
        guess, there = boxes_of(t.place, size)
        t.box = np.where(there[:, None], guess, t.box)
        taken = chosen(t.box, here)
        rows = np.flatnonzero(taken >= 0)
        t.age += 1
        if len(rows):
            t.correct(rows, here[taken[rows]])
            box, there = boxes_of(t.place[rows], size)
            t.box[rows], t.age[rows] = np.where(there[:, None], box, here[taken[rows]]), 0
        free = np.setdiff1d(np.arange(len(here)), taken[rows])
        t.begin(total, here[free])
        total += len(free)
        taken = np.append(np.where(taken >= 0, taken + start, -1), free + start)
        on = np.flatnonzero(t.age < FACE_AGE)
        told(now, on, taken[on])
        t.end()
        last = now
    if last is not None:
        unseen(last + 1, FACE_AGE)
    return out


def _followed(size: tuple[int, int] | None, predicted: bool):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.iloc[np.lexsort((part["id"], part["frame"]))]
        x, y, w, h = (part[c].to_numpy(float) for c in "xywh")
        found = follow(part["frame"].to_numpy("int64"), np.stack((x, y, x + w, y + h), axis=1), size)
        frame, track, row, age, box = (np.concatenate(c) for c in zip(*found))
        out = pd.DataFrame({"frame": frame, "track": track, "id": pd.arrays.IntegerArray(part["id"].to_numpy("int64")[row], row < 0), "age": age})
        out[["x1", "y1", "x2", "y2"]] = box.astype("int64")
        out = out.assign(video=part["video"].iloc[0], part=part["part"].iloc[0])[["video", "part", "frame", "track", "id", "age", "x1", "y1", "x2", "y2"]]
        return out if predicted else out[row >= 0]

    return run


def _tracked(boxes: DataFrame, size: tuple[int, int] | None, predicted: bool) -> DataFrame:
    """What faces_by_frame returns, without the rows of predictions if they aren't asked for: each track has a box, so its number stays."""
    rows = boxes.select(F.col("video").cast("long"), F.col("id").cast("long"), *(F.col(c).cast("int") for c in ("frame", "x", "y", "w", "h"))).dropna().where("w > 0 and h > 0")
    by = W.partitionBy("video").orderBy("frame")
    rows = rows.withColumn("_cut", (F.coalesce(F.col("frame") - F.lag("frame").over(by), F.lit(0)) > FACE_AGE).cast("long"))
    rows = dealt(rows.withColumn("part", F.sum("_cut").over(by)).drop("_cut"), "video", "part")
    found = rows.groupBy("video", "part").applyInPandas(_followed(size, predicted), _RESULT)
    number = F.dense_rank().over(W.partitionBy("video").orderBy("part", "track"))
    return found.select("video", "frame", (number - 1).cast("long").alias("track"), "id", "age", "x1", "y1", "x2", "y2")


def faces_by_frame(boxes: DataFrame, size: tuple[int, int] | None = None) -> DataFrame:
    """(video, frame, track, id, age, x1, y1, x2, y2): where each track is at each frame; id: the box that it took, null where it goes on by itself.

    boxes: (video, id, frame, x, y, w, h), whole numbers; size: width and height of the picture, to which boxes are cut. Tracks are
    numbered by video from 0 in the order in which they begin. Boxes without area or with a null in a column count as not there,
    boxes with equal ids as two; an empty table gives an empty one. The last predictions may lie behind a video's end.
    """
    return _tracked(boxes, size, True)


def faces_followed(boxes: DataFrame, size: tuple[int, int] | None = None) -> DataFrame:
    """(video, id, track): the track that each box belongs to."""
    return _tracked(boxes, size, False).select("video", "id", "track")
