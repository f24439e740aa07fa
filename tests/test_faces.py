"""Face tracks against a version that steps through every frame of the definition, one by one."""

import random
import time

import numpy as np
import pytest

from umbra.operators.faces import FACE_IOU, chosen, faces_by_frame, faces_followed, follow

MOVE = np.eye(8) + np.eye(8, k=4)
SEEN = np.eye(4, 8)


def cut(centre, size):
    cx, cy, w, h = centre
    if w <= 0 or h <= 0:
        return None
    x1, y1, x2, y2 = int(cx - w / 2), int(cy - h / 2), int(cx + w / 2), int(cy + h / 2)
    if size:
        x1, x2 = (max(0, min(v, size[0] - 1)) for v in (x1, x2))
        y1, y2 = (max(0, min(v, size[1] - 1)) for v in (y1, y2))
        if x2 <= x1 or y2 <= y1:
            return None
    return x1, y1, x2, y2


def shared(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def stepped(boxes, size=None):
    """(frame, track, id, age, x1, y1, x2, y2) of one video, frame by frame; boxes: (id, frame, x, y, w, h)."""
    tracks, out, total = [], [], 0
    frames = [b[1] for b in boxes]
    for frame in range(min(frames), max(frames) + 12) if boxes else ():
        here = sorted((i, (x, y, x + w, y + h)) for i, f, x, y, w, h in boxes if f == frame and w > 0 and h > 0)
        taken, going = set(), []
        for t in tracks:
            t["x"], t["p"] = MOVE @ t["x"], MOVE @ t["p"] @ MOVE.T + np.eye(8) * 0.03
            guess, best, at = cut(t["x"][:4], size) or t["box"], 0, -1
            for k, (_, box) in enumerate(here):
                if k not in taken and shared(guess, box) > best and shared(guess, box) >= 0.3:
                    best, at = shared(guess, box), k
            t["age"] += 1
            t["box"], t["id"] = guess, None
            if at >= 0:
                taken.add(at)
                t["id"], box = here[at]
                z = np.array([(box[0] + box[2]) / 2, (box[1] + box[3]) / 2, box[2] - box[0], box[3] - box[1]])
                k = t["p"] @ SEEN.T @ np.linalg.inv(SEEN @ t["p"] @ SEEN.T + np.eye(4) * 0.5)
                t["x"], t["p"] = t["x"] + k @ (z - SEEN @ t["x"]), (np.eye(8) - k @ SEEN) @ t["p"]
                t["age"], t["box"] = 0, cut(t["x"][:4], size) or box
            going.append(t)
        for k, (i, box) in enumerate(here):
            if k not in taken:
                z = [(box[0] + box[2]) / 2, (box[1] + box[3]) / 2, box[2] - box[0], box[3] - box[1], 0, 0, 0, 0]
                going.append({"x": np.array(z, float), "p": np.eye(8) * 0.1, "age": 0, "box": box, "n": total, "id": i})
                total += 1
        tracks = [t for t in going if t["age"] < 10]
        out += [(frame, t["n"], t["id"], t["age"], *t["box"]) for t in tracks]
    return sorted(out, key=str)


def random_video(seed):
    """Faces that cross, stand still, leave the picture, and gaps of 0 to 12 frames; some boxes twice, some without area."""
    rng, rows, frame, n = random.Random(seed), [], 1, 0
    faces = [[rng.randrange(0, 300), rng.randrange(0, 200), rng.choice([-9, -2, 0, 3, 8]), rng.choice([-4, 0, 5]), rng.randrange(15, 60)] for _ in range(4)]
    for _ in range(40):
        for face in faces:
            x, y, dx, dy, w = face
            if rng.random() < 0.8:
                n += 1
                rows.append((n, frame, int(x) + rng.randrange(-2, 3), int(y), w, w if rng.random() < 0.95 else 0))
                if rng.random() < 0.1:
                    n += 1
                    rows.append((n, *rows[-1][1:]))
        step = rng.choice([1, 1, 1, 1, 2, 3, 9, 10, 11, 12, 13]) if rng.random() < 0.5 else 1
        frame += step
        for face in faces:
            face[0] += face[2] * step
            face[1] += face[3] * step
    return rows


@pytest.fixture(scope="module")
def videos():
    return {v: random_video(v) for v in range(1, 9)}


@pytest.mark.parametrize("size", [None, (320, 240)])
def test_as_frame_by_frame(spark, videos, size):
    rows = [(v, *b) for v, boxes in videos.items() for b in boxes]
    df = spark.createDataFrame(rows, "video long, id long, frame int, x int, y int, w int, h int")
    got = faces_by_frame(df, size).collect()
    for v, boxes in videos.items():
        own = {(r.frame, r.track): (r.id, r.age, r.x1, r.y1, r.x2, r.y2) for r in got if r.video == v}
        want = {(f, t): x for f, t, *x in stepped(boxes, size)}
        assert {k: x[:2] for k, x in own.items()} == {k: tuple(x[:2]) for k, x in want.items()}
        assert all(abs(a - b) <= 1 for k, x in own.items() for a, b in zip(x[2:], want[k][2:]))  # corners are cut off to whole numbers
    seen = {(r.video, r.id) for r in faces_followed(df, size).collect()}
    assert seen == {(r[0], r[1]) for r in rows if r[6] > 0}


@pytest.mark.parametrize("gap,same", [(1, True), (9, True), (10, True), (11, False), (5000, False)])
def test_how_long_a_face_is_waited_for(spark, gap, same):
    df = spark.createDataFrame([(1, 1, 1, 10, 10, 40, 40), (1, 2, 1 + gap, 10, 10, 40, 40)], "video long, id long, frame int, x int, y int, w int, h int")
    got = {r.id: r.track for r in faces_followed(df).collect()}
    assert (got[1] == got[2]) is same


def test_older_tracks_choose_first(spark):
    """The first track takes the box that the second one would fit better."""
    rows = [(1, 1, 1, 0, 0, 40, 40), (1, 2, 1, 20, 0, 40, 40), (1, 3, 2, 15, 0, 40, 40)]
    df = spark.createDataFrame(rows, "video long, id long, frame int, x int, y int, w int, h int")
    got = {r.id: r.track for r in faces_followed(df).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def test_nulls_and_nothing(spark):
    rows = [(None, 1, 1, 0, 0, 4, 4), (1, None, 1, 0, 0, 4, 4), (1, 2, None, 0, 0, 4, 4), (1, 3, 1, 0, 0, None, 4), (1, 4, 1, 0, 0, 4, 4)]
    df = spark.createDataFrame(rows, "video long, id long, frame int, x int, y int, w int, h int")
    assert [tuple(r) for r in faces_followed(df).collect()] == [(1, 4, 0)]
    assert faces_by_frame(df.limit(0)).count() == 0


def test_choice_in_a_crowd():
    """More boxes than are compared at once, many of them equal: as by going from track to track."""
    rng = np.random.default_rng(3)
    guess, boxes = (np.hstack((at, at + rng.integers(4, 30, at.shape))).astype(float) for at in (rng.integers(0, 60, (700, 2)), rng.integers(0, 60, (400, 2))))
    boxes[200:300] = boxes[:100]
    free, want = list(range(400)), []
    for g in guess:
        best = max(free, key=lambda k: (shared(g, boxes[k]), -k), default=None)
        want.append(best if best is not None and shared(g, boxes[best]) >= FACE_IOU else -1)
        if want[-1] >= 0:
            free.remove(best)
    assert chosen(guess, boxes).tolist() == want


def test_crowded_frames_take_seconds():
    """Six frames of 5,000 boxes; it took 49 s when pairs were compared one by one."""
    rng = np.random.default_rng(5)
    frames, at = np.repeat(np.arange(1, 7), 5000), rng.integers(0, 60, (30000, 2))
    began = time.time()
    out = follow(frames, np.hstack((at, at + rng.integers(8, 40, (30000, 2)))).astype(float), (640, 480))
    assert sum((row >= 0).sum() for _, _, row, _, _ in out) == 30000 and time.time() - began < 15
