"""Order-dependent rules that plain windows cannot express, folded chunk by chunk.

Each rule is split in three: what a chunk does to any state that may enter it
(a small table per chunk), the walk over those tables per device, and the exact
replay inside a chunk once its entry state is known. A task reads its chunks one
after the other from sorted batches and holds one of them at a time;
``with_chunks`` keeps a chunk bounded.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundledger.operators.chunks import CHUNK, neighbour, with_chunks

Group = dict[str, np.ndarray]


def map_groups(df: DataFrame, cell: Sequence[str], order: Sequence[str], fn: Callable[[Group], Group], fields: Sequence[T.StructField]) -> DataFrame:
    """Apply ``fn`` to the sorted columns of each group; the result is the cell columns and ``fields``.

    Grouping a frame of many small groups in Python costs milliseconds a group.
    A window puts groups together, sorted, and marks where each begins, so that
    plain batches can be cut into array slices instead.
    """
    cell, order = list(cell), list(order)
    begins = F.row_number().over(Window.partitionBy(*cell).orderBy(*order)) == 1
    columns = df.columns
    marked = df.withColumn("_begins", begins)
    schema = T.StructType([*[df.schema[c] for c in cell], *fields])

    def finish(parts: list[Group]) -> Group:
        group = parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in columns}
        out = fn(group)
        n = len(next(iter(out.values())))
        return {**{c: np.repeat(group[c][:1], n) for c in cell}, **out}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_parts: list[Group] = []
        for pdf in batches:
            data = {c: pdf[c].to_numpy() for c in columns}
            done, pos = [], 0
            for begin in [*np.flatnonzero(pdf["_begins"].to_numpy()).tolist(), len(pdf)]:
                if begin > pos:
                    open_parts.append({c: v[pos:begin] for c, v in data.items()})
                if begin < len(pdf) and open_parts:
                    done.append(finish(open_parts))
                    open_parts = []
                pos = begin
            if done:
                yield pd.DataFrame({c: np.concatenate([d[c] for d in done]) for c in schema.names})
        if open_parts:
            yield pd.DataFrame(finish(open_parts))[schema.names]

    return marked.mapInPandas(run, schema)


def _long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def _double(name: str) -> T.StructField:
    return T.StructField(name, T.DoubleType())


def with_entry(rows: DataFrame, carry: DataFrame, cell: Sequence[str]) -> DataFrame:
    return rows.join(carry, list(cell), "left")


def last_accepted(times: np.ndarray, gap: int) -> np.ndarray:
    """For every position, the time of the last accepted event when the chain starts there (pointer doubling)."""
    n = len(times)
    jump = np.append(np.searchsorted(times, times + gap, side="left"), n)
    last = np.arange(n)
    while True:
        alive = jump[:n] < n
        if not alive.any():
            return times[last]
        last[alive] = last[jump[:n][alive]]
        jump = jump[jump]


def chain_from(times: np.ndarray, start: int, gap: int) -> list[int]:
    """Positions accepted when the first is ``start`` and each later one is at least ``gap`` after the last."""
    picked, i = [], start
    while i < len(times):
        picked.append(i)
        i = int(np.searchsorted(times, times[i] + gap, side="left"))
    return picked


def space_out(df: DataFrame, keys: Sequence[str], time_us: str, tie: str, gap_us: int, **chunking) -> DataFrame:
    """Keep an event only if it comes at least ``gap_us`` after the last kept event of its key.

    The last event kept before a chunk blocks at most one gap past the chunk's
    first event. Only for events in that span does a chunk list which event it
    would keep last; entries that end alike are merged.
    """
    keys, order = list(keys), [time_us, tie]
    rows = with_chunks(df.select(*keys, *order), keys, time_us, **chunking)
    cell = [*keys, CHUNK]

    def entries(g: Group) -> Group:
        t = np.unique(g[time_us])
        exits = last_accepted(t, gap_us)
        upto = min(len(t), int(np.searchsorted(t, t[0] + gap_us, side="left")) + 1)
        keep = np.append(exits[1:upto] != exits[: upto - 1], True)
        return {"enter_us": t[:upto][keep], "exit_us": exits[:upto][keep]}

    def walk(g: Group) -> Group:
        free, chunks, seen = np.iinfo(np.int64).min, [], []
        starts = np.flatnonzero(np.append(True, g[CHUNK][1:] != g[CHUNK][:-1]))
        for a, b in zip(starts, np.append(starts[1:], len(g[CHUNK]))):
            chunks.append(g[CHUNK][a])
            seen.append(free)
            i = a + int(np.searchsorted(g["enter_us"][a:b], free, side="left"))
            if i < b:
                free = g["exit_us"][i] + gap_us
        return {CHUNK: np.array(chunks), "free_us": np.array(seen, dtype=np.int64)}

    def replay(g: Group) -> Group:
        t = g[time_us]
        kept = chain_from(t, int(np.searchsorted(t, g["free_us"][0], side="left")), gap_us)
        return {c: g[c][kept] for c in order}

    table = map_groups(rows, cell, order, entries, [_long("enter_us"), _long("exit_us")])
    carry = map_groups(table, keys, [CHUNK, "enter_us"], walk, [rows.schema[CHUNK], _long("free_us")])
    out = map_groups(with_entry(rows, carry, cell), cell, order, replay, [rows.schema[c] for c in order])
    return out.drop(CHUNK)


def decayed_mean(x: np.ndarray, y0: float, keep: float, block: int = 256) -> np.ndarray:
    """y[i] = keep*y[i-1] + (1-keep)*x[i], in blocks of one small matrix product."""
    out = np.empty(len(x))
    block = min(block, max(len(x), 1))
    lag = np.arange(block)[:, None] - np.arange(block)[None, :]
    weights = np.where(lag >= 0, (1 - keep) * keep ** np.maximum(lag, 0), 0.0)
    decay = keep ** np.arange(1, block + 1)
    for s in range(0, len(x), block):
        part = x[s : s + block]
        m = len(part)
        out[s : s + m] = weights[:m, :m] @ part + decay[:m] * y0
        y0 = out[s + m - 1]
    return out


def smoothed_rate(df: DataFrame, keys: Sequence[str], time_us: str, tie: str, keep: float = 0.8, **chunking) -> DataFrame:
    """Exponential mean of the instantaneous rate 1e6/dt; rows without time passed keep the old value.

    A chunk maps its entry value y to ``a*y + b``, so entry values follow from a
    per-device walk over two numbers a chunk.
    """
    keys, order = list(keys), [time_us, tie]
    rows = with_chunks(df.select(*keys, *order), keys, time_us, **chunking)
    rows = neighbour(rows, keys, order, {"_before": F.col(time_us)})
    rows = rows.withColumn("_dt", F.coalesce(F.col(time_us) - F.col("_before"), F.lit(0))).drop("_before")
    cell = [*keys, CHUNK]

    def linear(g: Group) -> Group:
        x = 1e6 / g["_dt"][g["_dt"] > 0]
        return {"a": np.array([keep ** len(x)]), "b": decayed_mean(x, 0.0, keep)[-1:] if len(x) else np.zeros(1)}

    def walk(g: Group) -> Group:
        y, seen = 0.0, np.empty(len(g["a"]))
        for i, (a, b) in enumerate(zip(g["a"].tolist(), g["b"].tolist())):
            seen[i] = y
            y = a * y + b
        return {CHUNK: g[CHUNK], "y0": seen}

    def replay(g: Group) -> Group:
        moved = g["_dt"] > 0
        y0 = g["y0"][0]
        smooth = np.append(y0, decayed_mean(1e6 / g["_dt"][moved], y0, keep))
        return {time_us: g[time_us], tie: g[tie], "rate": smooth[np.cumsum(moved)]}

    table = map_groups(rows, cell, order, linear, [_double("a"), _double("b")])
    carry = map_groups(table, keys, [CHUNK], walk, [rows.schema[CHUNK], _double("y0")])
    out = map_groups(with_entry(rows, carry, cell), cell, order, replay, [*[rows.schema[c] for c in order], _double("rate")])
    return out.drop(CHUNK)


class PeakLinks:
    """Which score replaces which while the held one decays, found without a step a row.

    A score at row i is replaced by the first later v with v > score * decay ** (rows in between). In logarithms, with the
    decay of i rows added, that is the first later entry above a fixed bound, which a tree of maxima finds for all rows at
    once. Candidates are compared again as plain numbers, so that equal scores stay equal.
    """

    def __init__(self, scores: np.ndarray, decay: float) -> None:
        self.v, self.decay, self.rate = scores.astype("f8"), decay, -np.log(decay)
        n = len(self.v)
        self.log = np.full(n, -np.inf)
        positive = self.v > 0
        self.log[positive] = np.log(self.v[positive])
        self.lifted = self.log + self.rate * np.arange(n)
        leaves = 1 << max(n - 1, 0).bit_length()
        self.leaves, self.most = leaves, np.full(2 * leaves, -np.inf)
        self.most[leaves : leaves + n] = self.lifted
        width = leaves
        while width > 1:
            width //= 2
            self.most[width : 2 * width] = self.most[2 * width : 4 * width].reshape(width, 2).max(axis=1)
        at = np.arange(n)
        self.next = self._replaced_by(at + 1, self.lifted + self.rate, lambda rows, j: self.v[rows] * decay ** (j - 1 - rows))

    def _above(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """First row from ``start`` on that is above ``bound`` or as good as equal to it; the number of rows if none is."""
        n = len(self.v)
        bound = bound - 1e-9
        node = np.minimum(start, self.leaves - 1) + self.leaves
        found = start < n
        done = ~found | (self.most[node] > bound)
        # Up until a right neighbour has one, then down to the first row that does.
        while not done.all():
            right = ~done & (node % 2 == 0) & (self.most[np.minimum(node + 1, 2 * self.leaves - 1)] > bound)
            top = ~done & ~right & (node <= 1)
            found &= ~top
            node = np.where(right, node + 1, np.where(done, node, np.maximum(node // 2, 1)))
            done |= right | top
        while True:
            down = found & (node < self.leaves)
            if not down.any():
                break
            left = self.most[np.where(down, 2 * node, 0)] > bound
            node = np.where(down, 2 * node + ~left, node)
        return np.where(found, node - self.leaves, n)

    def _replaced_by(self, start: np.ndarray, bound: np.ndarray, held: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        n = len(self.v)
        out = np.full(len(start), n)
        todo = np.flatnonzero(bound < np.inf)
        while len(todo):
            j = self._above(start[todo], bound[todo])
            inside = j < n
            ok = np.zeros(len(todo), bool)
            ok[inside] = self.v[j[inside]] > held(todo[inside], j[inside])
            out[todo[ok]] = j[ok]
            again = inside & ~ok
            todo, start = todo[again], start.copy()
            start[todo] = j[again] + 1
        return out

    def first(self, held: float) -> int:
        """First row that replaces a peak held before row 0."""
        bound = np.array([np.log(held) if held > 0 else -np.inf])
        if held <= 0:
            positive = np.flatnonzero(self.v > held)
            return int(positive[0]) if len(positive) else len(self.v)
        return int(self._replaced_by(np.zeros(1, "i8"), bound, lambda _, j: held * self.decay**j)[0])

    def chain(self, first: int) -> np.ndarray:
        """Rows of the chain of replacements that begins at ``first``; links are doubled until none is left."""
        jump = np.append(self.next, len(self.v))
        rows = np.array([first], "i8") if first < len(self.v) else np.zeros(0, "i8")
        while len(rows) and jump[rows].min() < len(self.v):
            rows = np.unique(np.concatenate([rows, jump[rows][jump[rows] < len(self.v)]]))
            jump = jump[jump]
        return rows

    def ends(self) -> np.ndarray:
        """Last row of the chain that begins at each row."""
        last, jump = np.arange(len(self.v)), np.append(self.next, len(self.v))
        while True:
            alive = np.flatnonzero(jump[:-1] < len(self.v))
            if not len(alive):
                return last
            last[alive] = last[jump[alive]]
            jump = jump[jump]


#: Steps that are multiplied one by one, as a device does; by then a score has lost all digits that are looked at.
EXACT_STEPS = 256


#: A chunk of so few rows is folded row by row: the arrays of a long one would cost more.
SHORT = 256


def decayed(v: np.ndarray, steps: np.ndarray, decay: float) -> np.ndarray:
    """Scores after as many decays each."""
    out, steps = np.array(v, "f8"), np.asarray(steps)
    for step in range(1, min(int(steps.max(initial=0)), EXACT_STEPS) + 1):
        out[steps >= step] *= decay
    return out * decay ** np.maximum(steps - EXACT_STEPS, 0)


def hold_peak(x: np.ndarray, held: float, decay: float) -> np.ndarray:
    """A larger score replaces the held peak, any other decays it."""
    if len(x) <= SHORT:
        out = np.empty(len(x))
        for i, v in enumerate(x.tolist()):
            held = v if v > held else decay * held
            out[i] = held
        return out
    links = PeakLinks(x, decay)
    rows = links.chain(links.first(held))
    at = np.arange(len(x))
    newest = np.full(len(x), -1)
    newest[rows] = rows
    newest = np.maximum.accumulate(newest)
    return decayed(np.where(newest >= 0, links.v[newest], held), at - newest, decay)


def peak_exits(x: np.ndarray, decay: float) -> list[tuple[float, float, int]]:
    """What a chunk makes of each entry peak.

    Rows (bound, exit score, its decays): an entry peak whose logarithm is below the bound is first replaced where that
    bound arises, and from there the exit no longer depends on it. The last row has an infinite bound and a negative score:
    never replaced.
    """
    if len(x) <= SHORT:
        return _short_exits(x.tolist(), decay)
    links = PeakLinks(x, decay)
    best = np.maximum.accumulate(np.append(-np.inf, links.lifted[:-1]))
    rows = np.flatnonzero(links.lifted > best)
    end = links.ends()[rows]
    return [*zip(links.lifted[rows].tolist(), links.v[end].tolist(), (len(x) - 1 - end).tolist(), strict=True), (np.inf, -1.0, len(x))]


def _short_exits(values: list[float], decay: float) -> list[tuple[float, float, int]]:
    rate, best, rows = -math.log(decay), -math.inf, []
    for i, v in enumerate(values):
        if v > 0 and math.log(v) + rate * i > best:
            best = math.log(v) + rate * i
            rows.append((i, best))
    ends: dict[int, int] = {}
    for i, _ in rows:
        path, held = [i], values[i]
        for j in range(i + 1, len(values)):
            if values[j] > held:
                path.append(j)
                if j in ends:
                    break
                held = values[j]
            else:
                held *= decay
        ends.update(dict.fromkeys(path, ends.get(path[-1], path[-1])))
    return [*((bound, values[ends[i]], len(values) - 1 - ends[i]) for i, bound in rows), (math.inf, -1.0, len(values))]


def decayed_peak(
    df: DataFrame, keys: Sequence[str], time_us: str, tie: str, score: str, decay: float = 0.95, **chunking
) -> DataFrame:
    """Running peak of a score from zero up that decays on every row it is not beaten."""
    keys, order = list(keys), [time_us, tie]
    rows = with_chunks(df.select(*keys, *order, score), keys, time_us, **chunking)
    cell = [*keys, CHUNK]

    def table(g: Group) -> Group:
        bounds, exits, steps = map(np.array, zip(*peak_exits(g[score], decay)))
        return {"bound": bounds, "exit_peak": exits, "steps": steps}

    def walk(g: Group) -> Group:
        held, steps, chunks, seen, since = 0.0, 0, [], [], []
        starts = np.flatnonzero(np.append(True, g[CHUNK][1:] != g[CHUNK][:-1]))
        for a, b in zip(starts, np.append(starts[1:], len(g[CHUNK]))):
            chunks.append(g[CHUNK][a])
            seen.append(held)
            since.append(steps)
            entry = np.log(held) + np.log(decay) * steps if held > 0 else -np.inf
            i = a + int(np.searchsorted(g["bound"][a:b], entry, side="right"))
            again = g["exit_peak"][i] < 0
            held, steps = (held, steps + int(g["steps"][i])) if again else (float(g["exit_peak"][i]), int(g["steps"][i]))
        return {CHUNK: np.array(chunks), "held": np.array(seen), "since": np.array(since)}

    def replay(g: Group) -> Group:
        return {time_us: g[time_us], tie: g[tie], "peak": hold_peak(g[score], decayed(g["held"][:1], g["since"][:1], decay)[0], decay)}

    shapes = map_groups(rows, cell, order, table, [_double("bound"), _double("exit_peak"), _long("steps")])
    carry = map_groups(shapes, keys, [CHUNK, "bound"], walk, [rows.schema[CHUNK], _double("held"), _long("since")])
    out = map_groups(with_entry(rows, carry, cell), cell, order, replay, [*[rows.schema[c] for c in order], _double("peak")])
    return out.drop(CHUNK)
