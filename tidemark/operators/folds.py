"""Ordered folds: operators whose state at a row depends on their own decisions before it.

``scan`` deals rows by clip, sorts them, and runs through each partition batch by batch, carrying one small state. A clip
of any length is read as a stream, so memory is bounded by a batch; clips run in parallel, one clip in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import round_half_up
from tidemark.operators import images


def scan(df: DataFrame, read: list[str], start: Callable[[], dict], step: Callable, out: dict[str, str]) -> DataFrame:
    """``df`` with the columns ``out``: ``step(state, n, *read)`` for each row of a clip in order of n, from ``start()``."""
    spot = {c: i for i, c in enumerate(df.columns)}
    columns = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), *(f"`{c}` {t}" for c, t in out.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clip, state = None, None
        kinds = {"boolean": pa.bool_(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}
        for b in batches:
            rows = []
            for key, n, *values in zip(*[b.column(spot[c]).to_pylist() for c in ("clip_id", "n", *read)]):
                if state is None or key != clip:
                    clip, state = key, start()
                rows.append(step(state, n, *values))
            made = [pa.array([r[i] for r in rows], kinds[t]) for i, t in enumerate(out.values())]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, *out])

    return df.repartition("clip_id").sortWithinPartitions("clip_id", "n").mapInArrow(run, columns)


def keep_distant(df: DataFrame, flag: str, distance: int) -> DataFrame:
    """``df`` with ``kept``: flags at least ``distance`` rows after the last kept one."""

    def step(state: dict, n: int, hit: bool) -> tuple:
        kept = bool(hit) and n - state["last"] >= distance
        if kept:
            state["last"] = n
        return (kept,)

    return scan(df, [flag], lambda: {"last": -(10**9)}, step, {"kept": "boolean"})


def detect_scenes(
    df: DataFrame,
    diff: str = "diff",
    luma: str = "luma",
    threshold: float = 0.1,
    adaptive: float = 1.02,
    frequency: int = 0,
    min_length: int = 1,
    black: float = 0.1,
    white: float = 0.7,
) -> DataFrame:
    """``df`` with ``change`` and ``ratio``: segments that start where the difference jumps against the last judged one.

    Rows closer than ``min_length`` to the last start aren't judged and leave the state alone.
    """
    mid = (0.19, 0.70)

    def step(state: dict, n: int, d: float, y: float) -> tuple:
        if n == 0:
            state.update(last=0, diff=d, luma=y)
            return True, 1.0
        if n - state["last"] < min_length:
            return False, 0.0
        ratio = round_half_up(d / state["diff"])
        lit = mid[0] <= y <= mid[1]
        change = (
            (ratio > adaptive and d > threshold)
            or (frequency > 1 and n % frequency == 0)
            or (ratio > 2 and lit)
            or ratio > 15
            or (state["luma"] < mid[0] and lit)
        ) and black < y < white
        state["diff"] = d
        if change:
            state.update(last=n, luma=y)
        return change, ratio

    return scan(df, [diff, luma], dict, step, {"change": "boolean", "ratio": "double"})


def detect_edges(
    df: DataFrame, threshold: float = 0.1, factor: float = 2.0, min_length: int = 3, black: float = 0.1, white: float = 0.7
) -> DataFrame:
    """``df`` with ``reason``: which rule starts a segment, from a native flag, an edge and a plain difference.

    4: flag and edge at least threshold * factor; 3: flag; 2: edge above threshold * factor; 1: edge above the threshold
    and plain difference above 1.75 thresholds, ``min_length`` rows after the last start; 0: none. The same rule within
    ``max(3, int(factor / 2))`` rows, and luma outside its limits, are suppressed.
    """
    near, plain_least = max(3, int(factor / 2)), round_half_up(1.75 * threshold, 5)

    def step(state: dict, n: int, flag: bool, edge: float, plain: float, y: float) -> tuple:
        reason = 0
        if n == 0:
            reason = 4
        elif flag:
            reason = 4 if edge >= threshold * factor else 3
        elif edge > threshold * factor:
            reason = 2
        elif edge > threshold and plain > plain_least and n - state["last"] >= min_length:
            reason = 1
        if n and reason and (not black <= y <= white or (reason == state["reason"] and n - state["last"] < near)):
            reason = 0
        if reason:
            state.update(last=n, reason=reason)
        return (reason,)

    return scan(df, ["flag", "edge", "plain", "luma"], dict, step, {"reason": "long"})


def look_ahead(df: DataFrame, flag: str, window: int = 20) -> DataFrame:
    """``df`` with ``next_ref``: the next unread reference for each row in turn, or null.

    ``df`` has ``total``, the clip's references, and ``ahead``, those after the row; past half of the references none is
    handed out while at least ``window`` lie ahead.
    """

    def step(state: dict, n: int, total: int, ahead: int) -> tuple:
        if state["read"] >= total or (state["read"] > total // 2 and ahead >= window):
            return (None,)
        state["read"] += 1
        return (state["read"] - 1,)

    return scan(df, ["total", "ahead"], lambda: {"read": 0}, step, {"next_ref": "long"})


def stop_early(df: DataFrame, loss: str, patience: int, least: float = 0.0) -> DataFrame:
    """``df`` with ``best`` (smallest value so far), ``wait`` (rows without improvement) and ``stop``."""

    def step(state: dict, n: int, v: float) -> tuple:
        if v < state["best"] - least:
            state.update(best=v, wait=0)
        else:
            state["wait"] += 1
        return state["best"], state["wait"], state["wait"] > patience

    return scan(
        df, [loss], lambda: {"best": float("inf"), "wait": 0}, step, {"best": "double", "wait": "long", "stop": "boolean"}
    )


def filter_changes(
    df: DataFrame, flag: str, luma: str, threshold: float = 0.9, min_length: int = 3, dark: float = 0.19
) -> DataFrame:
    """``df`` with ``reason``: which rule lets a flagged row stand against the last kept one, 0 for none.

    1: both likenesses low; 2: from dark to lit; 3: likeness fair, but the distribution far. Within ``min_length`` rows the
    reason is noted as 4 more and the row isn't kept. Likenesses are 1 - |y - y0| and 1 - |y^2 - y0^2|.
    """

    def step(state: dict, n: int, hit: bool, y: float) -> tuple:
        if n == 0:
            state.update(last=0, y=y)
            return (1,)
        if not hit:
            return (0,)
        near, spread = round_half_up(1 - abs(y - state["y"])), round_half_up(1 - abs(y * y - state["y"] ** 2))
        reason = 0
        if near < threshold and spread < 0.95:
            reason = 1
        elif state["y"] < dark <= y:
            reason = 2
        elif near >= 0.69 and spread < 0.70:
            reason = 3
        if reason and n - state["last"] < min_length:
            return (reason + 4,)
        if reason:
            state.update(last=n, y=y)
        return (reason,)

    return scan(df, [flag, luma], dict, step, {"reason": "long"})


def filter_scenes(
    df: DataFrame,
    flag: str,
    luma: str,
    frame: str,
    width: int,
    threshold: float = 0.55,
    min_length: int = 1,
    black: float = 0.10,
    white: float = 0.70,
    frequency: int = 0,
    ratio: str | None = None,
    reason: str | None = None,
) -> DataFrame:
    """``df`` with ``change``, ``why``, ``ssim`` and ``likeness``: which flagged rows stand when their frames are compared with that of
    the last kept row.

    ``frame`` is binary, bytes of gray row by row, ``width`` a row; the state is one frame with its histogram. ``ssim`` is the mean
    structural similarity, ``likeness`` 1 less the Hellinger distance of the histograms; both are null where nothing is
    compared. ``why`` is 1 where both are low, 2 where a dark scene gets light while frames are alike, 3 where frames are alike but
    histograms far apart, 4 more within ``min_length`` rows of the last kept one, -1 for one that turns dark there, and 0 for none.
    Changes with luma outside ``black`` and ``white`` don't stand. With a ``frequency`` above 1, dark changes with a ``ratio`` below 2
    don't stand either. A ``reason`` above 1 overrides the comparison once the last kept row had none.
    """
    dark, light, dim, equal, spread, high = 0.19, 0.70, 0.14, 0.69, 0.70, 0.95

    def likeness(h: np.ndarray, k: np.ndarray) -> float:
        share = np.sqrt(h * k).sum() / np.sqrt(h.sum() * k.sum())
        return round_half_up(1 - float(np.sqrt(max(0.0, 1 - share))))

    def step(state: dict, n: int, hit: bool, y: float, raw: bytes, step_ratio: float | None, given: int | None) -> tuple:
        if not hit and n != 0:
            return False, 0, None, None
        gray = np.frombuffer(raw, np.uint8)
        bins = np.bincount(gray, minlength=256).astype(float)
        keep = lambda: state.update(last=n, gray=gray, bins=bins, luma=y, given=given or 0)
        if "last" not in state:
            keep()
            return True, 1, None, None
        why = 0
        if n - state["last"] < min_length:
            if min_length > 1 and n > 1 and state["luma"] >= dark > y:
                return False, -1, None, None
            why = 4
        inside = black < y < white
        near = far = None
        if threshold == 1:
            change, add = inside, 1
        else:
            a, b = (x.reshape(1, -1, width).astype(float) for x in (gray, state["gray"]))
            near, far = round_half_up(float(images.ssim(a, b)[0])), likeness(state["bins"], bins)
            change, add = False, 0
            if (given or 0) > 1 and state["given"] < 2:
                change = inside
            elif near < threshold and far < high:
                change, add = inside, 1
                if change and why == 0 and frequency > 1 and y < dim and (step_ratio is None or step_ratio < 2.0):
                    change = False
            elif near >= equal and state["luma"] < dark <= y:
                change, add = inside, 2
            elif near >= equal and far < spread:
                change, add = dark < y < light, 3
        if change:
            keep()
        return change, why + add if change else 0, near, far

    columns = {"_ratio": F.col(ratio) if ratio else F.lit(None).cast("double"), "_reason": F.col(reason) if reason else F.lit(None).cast("long")}
    out = {"change": "boolean", "why": "long", "ssim": "double", "likeness": "double"}
    return scan(df.withColumns(columns), [flag, luma, frame, "_ratio", "_reason"], dict, step, out).drop("_ratio", "_reason")


class Memory:
    """A working and a long-term memory of keys, values, shrinkages and usages."""

    def __init__(self, most: int, least: int, protos: int, long_most: int, top: int):
        self.most, self.least, self.protos, self.long_most, self.top = most, least, protos, long_most, top
        self.work: list[list] = []  # key, value, shrinkage, usage, rows since it came
        self.long: list[list] = []

    @staticmethod
    def similarity(keys: np.ndarray, shrink: np.ndarray, queries: np.ndarray, select: np.ndarray) -> np.ndarray:
        """Negative squared distances (keys down, queries across), weighted by each query's ``select`` and shrunk by each key's factor."""
        found = -(keys**2 @ select.T) + 2 * keys @ (queries * select).T - (select * queries**2).sum(1)
        return found * shrink[:, None] / np.sqrt(keys.shape[1])

    @staticmethod
    def softmax(scores: np.ndarray, top: int | None = None) -> np.ndarray:
        """Weights down each column, of the ``top`` best alone if given; ties by place."""
        if top is not None and top < len(scores):
            order = np.argsort(-scores, axis=0, kind="stable")
            scores = scores.copy()
            np.put_along_axis(scores, order[top:], -np.inf, 0)
        e = np.exp(scores - scores.max(0))
        return e / e.sum(0)

    def read(self, key: np.ndarray, select: np.ndarray) -> np.ndarray | None:
        """The value read out for a key; usages of what it is read from grow."""
        held = self.long + self.work
        if not held:
            return None
        keys, values, shrink = (np.array([h[i] for h in held]) for i in range(3))
        weight = self.softmax(self.similarity(keys, shrink, key[None], select[None]), self.top)[:, 0]
        for h, w in zip(held, weight):
            h[3] += w
            h[4] += 1
        return weight @ values

    def add(self, key: np.ndarray, value: np.ndarray, shrink: float, select: np.ndarray) -> None:
        """A new entry of the working memory, which is consolidated when it is full."""
        self.work.append([key, value, shrink, 0.0, 1e-7, select])
        if len(self.work) < self.most:
            return
        cut = len(self.work) - self.least + 1
        middle = self.work[1:cut]  # the first entry and the last stay
        self.work = self.work[:1] + self.work[cut:]
        use = np.array([h[3] / h[4] for h in middle])
        best = np.argsort(-use, kind="stable")[: self.protos]
        keys, values, shrink = (np.array([h[i] for h in middle]) for i in range(3))
        weight = self.softmax(self.similarity(keys, shrink, keys[best], np.array([middle[i][5] for i in best])))
        drawn, factor = weight.T @ values, weight.T @ shrink
        room = self.long_most - len(best)
        if len(self.long) > room:  # the least used go
            use = np.array([h[3] / h[4] for h in self.long])
            stay = np.sort(np.argsort(-use, kind="stable")[: max(room, 0)])
            self.long = [self.long[i] for i in stay]
        self.long += [[keys[i], v, float(f), 0.0, 1e-7] for i, v, f in zip(best, drawn, factor)]


def remember(
    df: DataFrame, key: str, value: str, shrink: str, select: str, every: int = 5, most: int = 10, least: int = 5, protos: int = 3, long_most: int = 24, top: int = 8
) -> DataFrame:
    """``df`` with ``read``, ``work``, ``long`` and ``usage``: values read from a working and a long-term memory as rows come.

    Each row's ``key`` is first read against all entries: the softmax of the ``top`` highest similarities weighs their values.
    Every ``every``-th row then enters the working memory. At ``most`` entries it keeps its first and its last ``least`` - 1; those in
    between are consolidated: the ``protos`` most used become prototypes of the long-term memory, with values and shrinkages read
    from all of them by similarity. The long-term memory evicts its least used entries before it passes ``long_most``. ``usage`` is
    that of all entries, long-term ones first. A clip's state is bounded by ``most`` and ``long_most``.
    """

    def step(state: Memory, n: int, k: list, v: list, s: float, e: list) -> tuple:
        k, v, e = (np.array(x, float) for x in (k, v, e))
        read = state.read(k, e)
        if n % every == 0:
            state.add(k, v, s, e)
        return None if read is None else read.tolist(), len(state.work), len(state.long), [float(h[3]) for h in state.long + state.work]

    start = lambda: Memory(most, least, protos, long_most, top)
    return scan(df, [key, value, shrink, select], start, step, {"read": "array<double>", "work": "long", "long": "long", "usage": "array<double>"})


def two_memories(df: DataFrame, every: int = 5, most: int = 10, least: int = 5, long_most: int = 24) -> DataFrame:
    """``df`` with ``work``, ``moved`` and ``long``: sizes of a working and a long-term memory as rows come.

    Every ``every``-th row enters the working memory. At ``most`` it keeps its first and its last ``least`` - 1 entries and
    hands the middle to the long-term memory, which then evicts down to ``long_most``.
    """

    def step(state: dict, n: int, is_ref: bool) -> tuple:
        moved = 0
        if n % every == 0 or is_ref:
            state["work"] += 1
        if state["work"] >= most:
            moved = state["work"] - least
            state["work"] = least
            state["long"] = min(state["long"] + moved, long_most)
        return state["work"], moved, state["long"]

    return scan(
        df, ["flag"], lambda: {"work": 0, "long": 0}, step, {"work": "long", "moved": "long", "long": "long"}
    )


def reduce_on_plateau(df: DataFrame, value: str, patience: int, factor: float = 0.2, least: float = 0.0, rate: float = 1.0) -> DataFrame:
    """``df`` with ``rate``: lowered by ``factor`` whenever a value has not fallen by ``least`` for more than ``patience`` rows."""

    def step(state: dict, n: int, v: float | None) -> tuple:
        if v is None:
            return (state["rate"],)
        if state["best"] is None or v + least < state["best"]:
            state.update(best=v, wait=0)
        else:
            state["wait"] += 1
            if state["wait"] > patience:
                state.update(rate=state["rate"] * factor, wait=0)
        return (state["rate"],)

    return scan(df, [value], lambda: {"best": None, "wait": 0, "rate": rate}, step, {"rate": "double"})


def propagate(df: DataFrame, value: str, flag: str, score: Callable[[float, float, float], float]) -> DataFrame:
    """``df`` with ``colour``: a reference row's own value, else ``score(value, last colour, last reference)``.

    A new reference resets the state; the first row counts as one. ``score`` runs inside tasks.
    """

    def step(state: dict, n: int, v: float, hit: bool) -> tuple:
        if n == 0 or hit:
            state.update(last=v, ref=v)
        else:
            state["last"] = score(v, state["last"], state["ref"])
        return (state["last"],)

    return scan(df, [value, flag], dict, step, {"colour": "double"})
