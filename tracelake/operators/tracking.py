"""Multi-object tracking of detections, one video at a time: Kalman prediction and two-stage optimal box matching.

Tracks are sequential state, so this is `applyInPandas` by video_id: memory is one video's detections (for longer ones
`streaming.tracked` keeps only the open tracks).  A constant-velocity Kalman filter over (centre, aspect, height) moves the boxes;
detections of at least HIGH are matched first, by overlap times confidence, then those of at least LOW by overlap, each time by an
assignment of least total cost among boxes of the same label.  Unmatched strong detections start tracks; a track that does not start in the first
frame counts only from its second detection on; tracks unseen for BUFFER frames end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

HIGH, LOW, START, BUFFER, MATCH = 0.25, 0.1, 0.25, 30, 0.8
#: Largest costs (1 - similarity) of the second stage and of tracks seen once.
SECOND, ONCE = 0.5, 0.7
#: The filter's standard deviations of place and speed, in heights.
PLACE, SPEED = 1 / 20, 1 / 160
SCHEMA = "video_id string, track_id string, label string, t double, frame_path string, x1 double, y1 double, x2 double, y2 double, conf double"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_STEP = np.eye(8) + np.eye(8, k=4)


def assignment(cost: np.ndarray) -> np.ndarray:
    """The column of each row in an assignment of least total cost (shortest augmenting paths); -1 where rows outnumber columns."""
    n, m = cost.shape
    if n > m:
        out = np.full(n, -1)
        rows = assignment(cost.T)
        out[rows] = np.arange(m)
        return out
    row_price, column_price, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for start in range(n):
        gap, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, last = start, -1
        while row >= 0:
            slack = cost[row] - row_price[row] - column_price
            closer = ~done & (slack < gap)
            gap[closer], came[closer] = slack[closer], last
            column = int(np.where(done, np.inf, gap).argmin())
            step = gap[column]
            row_price[start] += step
            row_price[owner[done]] += step
            column_price[done] -= step
            gap[~done] -= step
            done[column] = True
            last, row = column, owner[column]
        while last >= 0:  # turn the path over
            before = came[last]
            owner[last] = owner[before] if before >= 0 else start
            last = before
    out = np.empty(n, np.int64)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    shared = np.prod(np.clip(high - low, 0, None), axis=2)
    area = lambda x: np.prod(np.clip(x[:, 2:] - x[:, :2], 0, None), axis=1)
    return shared / np.maximum(area(a)[:, None] + area(b)[None] - shared, 1e-9)


def _measured(boxes: np.ndarray) -> np.ndarray:
    """Boxes as centre, aspect and height."""
    size = boxes[:, 2:] - boxes[:, :2]
    return np.column_stack([(boxes[:, :2] + boxes[:, 2:]) / 2, size[:, 0] / np.maximum(size[:, 1], 1e-9), size[:, 1]])


def _spread(height: np.ndarray, place: float, aspect: float, speed: float | None = None, turn: float = 1e-5) -> np.ndarray:
    """Diagonal variances for boxes of these heights: of place, and of speed if asked for."""
    own = [place * height, place * height, np.full(len(height), aspect), place * height]
    if speed is not None:
        own += [speed * height, speed * height, np.full(len(height), turn), speed * height]
    return np.square(np.column_stack(own))


class Tracker:
    """State of one video: the open tracks, the number of tracks made so far, frames seen."""

    def __init__(self):
        self.made = self.frames = 0
        self.id, self.seen, self.sure = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        self.mean, self.cov, self.label = np.empty((0, 8)), np.empty((0, 8, 8)), np.empty(0, object)

    def advance(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Track points of the next frames; rows with a missing box are skipped."""
        rows = rows.dropna(subset=["x1", "y1", "x2", "y2", "conf"])
        rows = rows[rows["conf"] >= LOW].sort_values(["t", "frame_path", "conf"], ascending=[True, True, False], kind="stable").reset_index(drop=True)
        boxes, conf, labels = rows[["x1", "y1", "x2", "y2"]].to_numpy(float), rows["conf"].to_numpy(float), rows["label"].to_numpy(object)
        t, path = rows["t"].to_numpy(), rows["frame_path"].to_numpy(object)
        edge = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (path[1:] != path[:-1]))) if len(rows) else np.empty(0, np.int64)
        track, place = [], []
        for a, b in zip(edge.tolist(), np.append(edge[1:], len(rows)).tolist(), strict=False):
            own, at = self._frame(boxes[a:b], conf[a:b], labels[a:b])
            track.append(own)
            place.append(a + at)
        out = rows.take(np.concatenate([*place, np.empty(0, np.int64)]).astype(np.int64))
        numbers = np.concatenate([*track, np.empty(0, np.int64)]).astype(np.int64)
        return out.assign(track_id=out["video_id"].astype(str) + ":" + pd.Series(numbers, out.index).astype(str))[_COLUMNS]

    def _frame(self, boxes: np.ndarray, conf: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Track numbers and places of the detections of one frame that belong to sure tracks."""
        self.frames += 1
        if len(self.id):
            self.mean = self.mean @ _STEP.T
            height = self.mean[:, 3]
            self.cov = _STEP @ self.cov @ _STEP.T + _diagonal(_spread(height, PLACE, 1e-2, SPEED))
        free, met = np.ones(len(boxes), bool), np.full(len(boxes), -1)
        live = np.ones(len(self.id), bool)
        for wanted, some, weighed, limit in (
            (self.sure, conf >= HIGH, True, MATCH),
            (self.sure & (self.seen == self.frames - 1), conf < HIGH, False, SECOND),
            (~self.sure, conf >= HIGH, True, ONCE),
        ):
            i, j = np.flatnonzero(wanted & live), np.flatnonzero(some & free)
            for row, column in self._pairs(i, j, boxes, conf if weighed else None, labels, limit):
                free[column], live[row], met[column] = False, False, row
        hit = np.flatnonzero(met >= 0)
        self._corrected(met[hit], boxes[hit])
        begun = np.flatnonzero(free & (conf >= START))
        first = len(self.id)
        self._opened(boxes[begun], labels[begun])
        met[begun] = np.arange(first, first + len(begun))
        shown = np.flatnonzero(met >= 0)
        shown = shown[self.sure[met[shown]]]
        out = self.id[met[shown]], shown
        # a track seen once must be seen again in the next frame
        stay = (self.frames - self.seen <= np.where(self.sure, BUFFER, 0))
        self.id, self.seen, self.sure, self.mean, self.cov, self.label = (x[stay] for x in (self.id, self.seen, self.sure, self.mean, self.cov, self.label))
        return out

    def _boxes(self, at: np.ndarray) -> np.ndarray:
        x, y, aspect, height = self.mean[at, :4].T
        return np.column_stack([x - aspect * height / 2, y - height / 2, x + aspect * height / 2, y + height / 2])

    def _pairs(self, i, j, boxes, conf, labels, limit):
        if not len(i) or not len(j):
            return
        alike = overlaps(self._boxes(i), boxes[j])
        if conf is not None:
            alike = alike * conf[j]
        alike[self.label[i][:, None] != labels[j][None]] = 0
        cost = np.minimum(1 - alike, limit)  # being left out costs as much as the worst pair
        for row, column in enumerate(assignment(cost).tolist()):
            if column >= 0 and cost[row, column] < limit:
                yield i[row], j[column]

    def _corrected(self, at: np.ndarray, boxes: np.ndarray) -> None:
        if not len(at):
            return
        mean, cov = self.mean[at], self.cov[at]
        noise = _diagonal(_spread(mean[:, 3], PLACE, 1e-1))
        gain = np.linalg.solve(cov[:, :4, :4] + noise, cov[:, :4, :]).transpose(0, 2, 1)
        self.mean[at] = mean + np.einsum("nij,nj->ni", gain, _measured(boxes) - mean[:, :4])
        self.cov[at] = cov - gain @ cov[:, :4, :]
        self.seen[at], self.sure[at] = self.frames, True

    def _opened(self, boxes: np.ndarray, labels: np.ndarray) -> None:
        n = len(boxes)
        if not n:
            return
        self.id = np.append(self.id, self.made + 1 + np.arange(n))
        self.made += n
        self.seen, self.sure = np.append(self.seen, np.full(n, self.frames)), np.append(self.sure, np.full(n, self.frames == 1))
        measured = _measured(boxes)
        self.mean = np.concatenate([self.mean, np.column_stack([measured, np.zeros((n, 4))])])
        self.cov = np.concatenate([self.cov, _diagonal(_spread(measured[:, 3], 2 * PLACE, 1e-2, 10 * SPEED))])
        self.label = np.append(self.label, labels)


def _diagonal(values: np.ndarray) -> np.ndarray:
    return values[:, :, None] * np.eye(values.shape[1])


def track_video(rows: pd.DataFrame) -> pd.DataFrame:
    """Tracks of one whole video, without repeats of a track's point."""
    return Tracker().advance(rows).drop_duplicates(["track_id", "t", "x1", "y1", "x2", "y2"])


def tracked(detections: DataFrame) -> DataFrame:
    """Track points of detections (video_id, label, t, frame_path, x1, y1, x2, y2, conf)."""
    columns = ["video_id", "label", "t", "frame_path", "x1", "y1", "x2", "y2", "conf"]
    return detections.select(*columns).groupBy("video_id").applyInPandas(track_video, SCHEMA)
