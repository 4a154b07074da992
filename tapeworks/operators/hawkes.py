"""Multivariate Hawkes processes with one exponential decay: closed forms, simulation, replays.

Parameters are d x d matrices on the driver; paths are rows, one group a path. The Markov state Z decays at
rate beta and gains one at an event of its own type; the intensity is mu + A Z.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks import schema


def expm(a: np.ndarray) -> np.ndarray:
    """The matrix exponential: a Taylor polynomial of a halved matrix, squared back."""
    norm = float(np.abs(a).sum(axis=0).max())
    s = max(0, math.ceil(math.log2(norm)) + 4) if norm > 0 else 0
    x = a / 2.0**s
    out = term = np.eye(len(a))
    for k in range(1, 19):
        term = term @ x / k
        out = out + term
    for _ in range(s):
        out = out @ out
    return out


def lyapunov(k: np.ndarray, q: np.ndarray) -> np.ndarray:
    """V with K V + V K' = q, through the Kronecker form."""
    eye = np.eye(len(k))
    v = np.linalg.solve(np.kron(k, eye) + np.kron(eye, k), q.reshape(-1))
    return v.reshape(k.shape)


def spectral_radius(m: np.ndarray) -> float:
    return float(np.max(np.abs(np.linalg.eigvals(m))))


def rescaled(shape, decay: float, branching_ratio: float) -> np.ndarray:
    """An excitation of the given shape whose branching matrix has the given radius."""
    shape = np.asarray(shape, float)
    radius = spectral_radius(shape / decay)
    if radius <= 0:
        raise ValueError("a shape without excitation has no branching ratio to scale")
    return shape * (branching_ratio / radius)


def cross_pressure_scaled(shape, pressure, factor: float) -> np.ndarray:
    """A shape with the entries between types of opposite pressure multiplied by a factor."""
    p = np.asarray(pressure, float)
    return np.where(p[:, None] != p[None, :], np.asarray(shape, float) * factor, shape)


@dataclass(frozen=True, eq=False)
class Hawkes:
    """Baseline mu (d), excitation A (row excited, column exciting) and decay beta of a stationary process."""

    mu: np.ndarray
    a: np.ndarray
    beta: float

    def __post_init__(self):
        mu, a = np.asarray(self.mu, float), np.asarray(self.a, float)
        object.__setattr__(self, "mu", mu)
        object.__setattr__(self, "a", a)
        d = len(mu)
        if mu.ndim != 1 or d < 1 or a.shape != (d, d):
            raise ValueError(f"the baseline {mu.shape} and the excitation {a.shape} do not match")
        if not (np.isfinite(mu).all() and np.isfinite(a).all() and math.isfinite(self.beta)):
            raise ValueError("parameters must be finite")
        if self.beta <= 0 or (mu < 0).any() or (a < 0).any() or mu.sum() <= 0:
            raise ValueError("the decay and the total baseline must be positive, all else non-negative")
        if self.branching_ratio >= 1:
            raise ValueError(f"not stationary: branching ratio {self.branching_ratio}")

    @property
    def d(self) -> int:
        return len(self.mu)

    @property
    def gamma(self) -> np.ndarray:
        return self.a / self.beta

    @property
    def drift(self) -> np.ndarray:
        return self.a - self.beta * np.eye(self.d)

    @property
    def branching_ratio(self) -> float:
        return spectral_radius(self.gamma)

    @property
    def resolvent(self) -> np.ndarray:
        return np.linalg.inv(np.eye(self.d) - self.gamma)

    @property
    def rates(self) -> np.ndarray:
        """The stationary intensity."""
        return np.linalg.solve(np.eye(self.d) - self.gamma, self.mu)

    @classmethod
    def from_rates(cls, rates, shape, beta: float, branching_ratio: float) -> Hawkes:
        """The process with given stationary rates; refused where that needs a negative baseline."""
        a, rates = rescaled(shape, beta, branching_ratio), np.asarray(rates, float)
        mu = rates - a @ rates / beta
        if (mu < 0).any():
            raise ValueError(f"components {np.flatnonzero(mu < 0).tolist()} would need a negative baseline")
        return cls(mu, a, beta)

    def endogenous_fraction(self) -> float:
        return 1 - float(self.mu.sum() / self.rates.sum())

    def mean_cluster_size(self) -> float:
        return float(np.ones(self.d) @ self.resolvent @ self.mu / self.mu.sum())

    def _signed(self, pressure, m: np.ndarray) -> float:
        p = self._pressure(pressure)
        return float((p @ m * p) @ self.rates / self.rates.sum())

    def _pressure(self, pressure) -> np.ndarray:
        p = np.asarray(pressure, float)
        if p.shape != (self.d,):
            raise ValueError(f"pressure must have {self.d} entries")
        return p

    def signed_endogenous_fraction(self, pressure) -> float:
        return self._signed(pressure, self.gamma)

    def signed_descendants(self, pressure) -> float:
        return self._signed(pressure, self.resolvent)

    def signed_excitation(self, pressure) -> np.ndarray:
        p = self._pressure(pressure)
        return p @ self.a / p

    def signed_excitation_at(self, pressure, h: float) -> np.ndarray:
        p = self._pressure(pressure)
        return p @ self.a @ self.response_integral(h) / p

    def state_mean(self) -> np.ndarray:
        return self.rates / self.beta

    def state_covariance(self) -> np.ndarray:
        return lyapunov(self.drift, -np.diag(self.rates))

    def count_covariance_rate(self) -> np.ndarray:
        return self.resolvent @ np.diag(self.rates) @ self.resolvent.T

    def relaxation_time(self) -> float:
        return 1 / (self.beta * (1 - self.branching_ratio))

    def _blocks(self, h: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return response_blocks(self.a, self.beta, h)

    def response(self, h: float) -> np.ndarray:
        return self._blocks(h)[0]

    def response_integral(self, h: float) -> np.ndarray:
        return self._blocks(h)[1]

    def forward_state(self, z, h: float) -> dict[str, np.ndarray]:
        """The mean state h later, by term and about the stationary mean."""
        e, phi, _ = self._blocks(h)
        m = self.state_mean()
        return {"from_state": e @ z, "from_baseline": phi @ self.mu, "total": e @ z + phi @ self.mu, "stationary": m, "deviation": e @ (np.asarray(z) - m)}

    def forward_counts(self, z, h: float) -> dict[str, np.ndarray]:
        """Expected counts over the next h, by term and about the stationary rates."""
        _, phi, double = self._blocks(h)
        terms = {"immigrants": h * self.mu, "descendants_of_state": self.a @ phi @ z, "descendants_of_immigrants": self.a @ double @ self.mu}
        return terms | {"total": sum(terms.values()), "stationary": h * self.rates, "deviation": self.a @ phi @ (np.asarray(z) - self.state_mean())}

    # Frames.

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """Long form: one row a (Component, Cause), the baseline on the diagonal."""
        rows = [(i, j, float(self.mu[i]) if i == j else None, float(self.a[i, j]), float(self.beta)) for i in range(self.d) for j in range(self.d)]
        return spark.createDataFrame(rows, schema.HAWKES)

    @classmethod
    def from_frame(cls, df: DataFrame) -> Hawkes:
        """Back from long form; the grid must be square and complete and the decay one."""
        rows = df.limit(10_001).collect()
        if len(rows) > 10_000:
            raise ValueError("a parameter frame has at most 10000 rows")
        return cls.from_records([r.asDict() for r in rows])

    @classmethod
    def from_records(cls, rows: list[dict]) -> Hawkes:
        if len({r["Decay"] for r in rows}) != 1:
            raise ValueError("one decay is shared by every pair")
        d = max(r["Component"] for r in rows) + 1
        grid = {(r["Component"], r["Cause"]): r for r in rows}
        if len(grid) != len(rows) or set(grid) != {(i, j) for i in range(d) for j in range(d)}:
            raise ValueError("the (Component, Cause) grid must be complete and square")
        if any(grid[i, i]["BaseIntensity"] is None for i in range(d)):
            raise ValueError("every diagonal row carries a baseline")
        return cls(np.array([grid[i, i]["BaseIntensity"] for i in range(d)]), np.array([[grid[i, j]["Kernel"] for j in range(d)] for i in range(d)]), float(rows[0]["Decay"]))


def response_blocks(a: np.ndarray, beta: float, h: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp(K h), its integral and its double integral, at any branching ratio, from one block exponential."""
    d = len(a)
    g = np.zeros((3 * d, 3 * d))
    g[:d, :d] = a - beta * np.eye(d)
    g[:d, d : 2 * d] = g[d : 2 * d, 2 * d :] = np.eye(d)
    e = expm(g * h)
    return e[:d, :d], e[:d, d : 2 * d], e[:d, 2 * d :]


class Simulator:
    """A path that can be continued: state, clock, and the event drawn past the last horizon."""

    def __init__(self, p: Hawkes, rng: np.random.Generator, state=None, thinning: bool = False):
        self.p, self.rng, self.t, self.thinning, self.held = p, rng, 0.0, thinning, None
        self.z = np.zeros(p.d) if state is None else np.array(state, float)
        if self.z.shape != (p.d,) or (self.z < 0).any():
            raise ValueError("a state has one non-negative entry a type")

    def _wait(self) -> None:
        p = self.p
        total = lambda: float(p.mu.sum() + p.a.sum(axis=0) @ self.z)
        if not self.thinning:
            # The smaller of a wait at the baseline and one, maybe endless, at the decaying excess.
            base = float(p.mu.sum())
            wait, excess = self.rng.exponential() / base, total() - base
            if excess > 0:
                left = 1 - p.beta * self.rng.exponential() / excess
                if left > 0:
                    wait = min(wait, -math.log(left) / p.beta)
            self._pass(wait)
            return
        bound = total()
        while True:
            self._pass(self.rng.exponential() / bound)
            now = total()
            if self.rng.random() * bound <= now:
                return
            bound = now

    def _pass(self, dt: float) -> None:
        self.t += dt
        self.z *= math.exp(-self.p.beta * dt)

    def step(self) -> tuple[float, int]:
        self._wait()
        cumulative = np.cumsum(self.p.mu + self.p.a @ self.z)
        k = min(int(np.searchsorted(cumulative, self.rng.random() * cumulative[-1])), self.p.d - 1)
        self.z[k] += 1
        return self.t, k

    def events(self, horizon: float):
        """The events up to a horizon; the first one past it is kept for the next call."""
        while True:
            t, k = self.held or self.step()
            self.held = None
            if t > horizon:
                self.held = (t, k)
                return
            yield t, k


def seeded(seed: int, path: int) -> np.random.Generator:
    """The generator of one path, the same wherever the path is computed."""
    return np.random.default_rng(np.random.SeedSequence(seed, spawn_key=(path,)))


def simulate(spark: SparkSession, p: Hawkes, paths: int, horizon: float, seed: int, thinning: bool = False, state=None) -> DataFrame:
    """(path_id, n, t, type): independent paths, dealt across tasks, streamed out in batches."""

    def run(batches):
        for batch in batches:
            for path in batch["id"]:
                rows, n = [], 0
                for t, k in Simulator(p, seeded(seed, int(path)), state, thinning).events(horizon):
                    rows.append((int(path), n, t, k))
                    n += 1
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["path_id", "n", "t", "type"])
                        rows = []
                yield pd.DataFrame(rows, columns=["path_id", "n", "t", "type"])

    return spark.range(paths).repartition(min(paths, spark.sparkContext.defaultParallelism * 4)).mapInPandas(run, schema.PATHS)


#: A path is replayed in blocks of so many events.
BLOCK_EVENTS = 1 << 16
_PLACED = "path_id long, block long, n long, t double, type int, z array<double>, counts array<double>"


def affine_scan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All x_i = a_i x_(i-1) + b_i with x before the first being 0; `a` has one entry a row, `b` a vector.

    Steps compose to steps, (a, b) after (c, d) being (a c, a d + b), so spans of 1, 2, 4 ... rows are composed at once.
    """
    a, b, span = a.copy(), b.copy(), 1
    while span < len(a):
        b[span:] += a[span:, None] * b[:-span]
        a[span:] *= a[:-span]
        span *= 2
    return b


class _Scan:
    """Sums of a stream of events in order of path, block and n; what a batch leaves goes on in the next.

    A row of type -1 gives the sums and the time that its block begins with; a block without one begins with none at 0.
    """

    def __init__(self, beta: float, d: int):
        self.beta, self.d = beta, d
        self.key, self.t, self.z, self.counts = None, 0.0, np.zeros(d), np.zeros(d)

    def batch(self, path: np.ndarray, block: np.ndarray, t: np.ndarray, kind: np.ndarray, z0: np.ndarray, n0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums, counts) just before each row; a carry's row has its own."""
        n, carry = len(t), kind < 0
        if not n:
            return np.zeros((0, self.d)), np.zeros((0, self.d))
        new = np.ones(n, bool)
        new[1:] = (path[1:] != path[:-1]) | (block[1:] != block[:-1])
        new[0] = self.key != (path[0], block[0])
        hot = np.zeros((n, self.d))
        hot[np.flatnonzero(~carry), kind[~carry]] = 1
        before, last = np.empty(n), np.vstack([np.zeros(self.d), hot[:-1]])
        before[1:], before[0] = t[:-1], self.t
        before[new] = 0.0
        fade = np.where(new, 0.0, np.exp(-self.beta * np.maximum(t - before, 0.0)))
        add, step = fade[:, None] * last, np.where(new[:, None], 0.0, last)
        if not new[0]:
            add[0] = fade[0] * self.z
            step[0] = self.counts
        # A block's first row starts anew, from its carry if it is one.
        add[new] = step[new] = 0.0
        add[carry], step[carry] = z0[carry], n0[carry]
        z = affine_scan(fade, add)
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        total = np.cumsum(step, axis=0)
        counts = total - np.where((start > 0)[:, None], total[start - 1], 0.0)
        self.key, self.t, self.z, self.counts = (path[-1], block[-1]), float(t[-1]), z[-1] + hot[-1], counts[-1] + hot[-1]
        return z, counts


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    """A column of arrays as a matrix, NULL as zeros."""
    out = np.zeros((len(column), d))
    some = np.asarray(column.is_valid())
    if some.any():
        out[some] = column.drop_null().flatten().to_numpy().reshape(-1, d)
    return out


def _scanned(scan: _Scan, rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    path, block, n, t, kind = (c.to_numpy(zero_copy_only=False) for c in rows.columns[:5])
    return path, block, n, t, kind, *scan.batch(path, block, t, kind, _vectors(rows.column(5), scan.d), _vectors(rows.column(6), scan.d))


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1] or 1, dtype=np.int32)), pa.array(np.ascontiguousarray(m).ravel()))


def _ends(beta: float, d: int, size: int):
    """(path_id, block, t, z, counts): what each full block leaves by its own events; only a full one has another after it."""

    def run(batches):
        scan = _Scan(beta, d)
        for rows in batches:
            path, block, n, t, kind, z, counts = _scanned(scan, rows)
            at = np.flatnonzero(n % size == size - 1)
            hot = np.zeros((len(at), d))
            hot[np.arange(len(at)), kind[at]] = 1
            yield pa.RecordBatch.from_arrays([pa.array(path[at]), pa.array(block[at]), pa.array(t[at]), _lists(z[at] + hot), _lists(counts[at] + hot)], ["path_id", "block", "t", "z", "counts"])

    return run


def _carried(beta: float):
    """What each block of one path begins with: the ends of the blocks before it, faded and added up."""

    def run(ends: pa.Table) -> pa.Table:
        ends = ends.sort_by("block").combine_chunks()
        t, z, counts = ends["t"].to_numpy(), np.array(ends["z"].to_pylist()), np.array(ends["counts"].to_pylist())
        z = affine_scan(np.exp(-beta * np.diff(t, prepend=t[:1])), z)
        block = ends["block"].to_numpy() + 1
        one = lambda x, kind: pa.array(np.full(len(t), x), kind)
        return pa.table([ends["path_id"], pa.array(block), one(-1, pa.int64()), pa.array(t), one(-1, pa.int32()), _lists(z), _lists(np.cumsum(counts, axis=0))], names=["path_id", "block", "n", "t", "type", "z", "counts"])

    return run


def replay(paths: DataFrame, beta: float, d: int, p: Hawkes | None = None, block: int = BLOCK_EVENTS) -> DataFrame:
    """(path_id, n, t, type, z, counts, intensities, compensators) just before each event.

    `n` numbers a path's events without a gap, from 0 or 1. A path is cut into blocks that are scanned side by side: first
    each by itself, for what it leaves; these ends are composed along the path (a row a block); then each again from what
    it begins with. Without `p` the last two columns are NULL.
    """

    def run(batches):
        scan = _Scan(beta, d)
        for rows in batches:
            path, _, n, t, kind, z, counts = _scanned(scan, rows)
            keep = kind >= 0
            path, n, t, kind, z, counts = (x[keep] for x in (path, n, t, kind, z, counts))
            lam = comp = pa.nulls(len(t), pa.list_(pa.float64()))
            if p is not None:
                lam, comp = _lists(p.mu + z @ p.a.T), _lists(np.outer(t, p.mu) + (counts - z) @ p.a.T / beta)
            yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(n), pa.array(t), pa.array(kind), _lists(z), _lists(counts), lam, comp], ["path_id", "n", "t", "type", "z", "counts", "intensities", "compensators"])

    ways = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: df.repartition(ways, "path_id", "block").sortWithinPartitions("path_id", "block", "n")
    none = F.lit(None).cast("array<double>")
    rows = paths.select(F.col("path_id").cast("long").alias("path_id"), F.floor(F.col("n") / block).alias("block"), F.col("n").cast("long").alias("n"), F.col("t").cast("double").alias("t"), F.col("type").cast("int").alias("type"), none.alias("z"), none.alias("counts"))
    # Only a full block leaves something to another; there is one in `block` events at most, and none where paths are short.
    full = rows.where(F.col("n") % block == block - 1).select("path_id", "block")
    ends = dealt(rows.join(F.broadcast(full), ["path_id", "block"], "left_semi").select(rows.columns)).mapInArrow(_ends(beta, d, block), "path_id long, block long, t double, z array<double>, counts array<double>")
    carried = ends.groupBy("path_id").applyInArrow(_carried(beta), _PLACED)
    return dealt(rows.unionByName(carried)).mapInArrow(run, "path_id long, n long, t double, type int, z array<double>, counts array<double>, intensities array<double>, compensators array<double>")


def state_before(paths: DataFrame, beta: float, d: int) -> DataFrame:
    """(path_id, n, z0..): the decayed counts just before each event, streamed path by path."""
    return replay(paths, beta, d).select("path_id", "n", *(F.get("z", F.lit(k)).alias(f"z{k}") for k in range(d)))


def _by_tick(paths: DataFrame, clock: list[float], counted: Callable[[Column, Column], Column], sums: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """(path_id, ticks): for every path an array over the clock of the sums of its events since the tick before, an
    event going to the first tick at which it is counted. One row an event; events after the clock give none."""
    times = F.array(*(F.lit(float(x)) for x in clock))
    at = F.array_position(F.transform(times, lambda x: counted(F.col("t"), x)), F.lit(True)).cast("int") - 1
    rows = paths.select("path_id", "t", "type", F.when(at >= 0, at).alias("tick"))
    cells = sums(F.get(times, F.col("tick")))
    some = rows.groupBy("path_id", "tick").agg(*(c.alias(name) for name, c in cells.items()))
    return some.groupBy("path_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("tick").isNotNull(), F.struct("tick", F.array(*cells))))).alias("ticks"))


def state_on_clock(paths: DataFrame, beta: float, d: int, clock: list[float], opening=None) -> DataFrame:
    """(path_id, t, z) at clock times, an event at a clock time not yet counted.

    Events are summed up to their next tick; from tick to tick the sums fade.
    """
    times = sorted(clock)
    z0 = np.zeros(d) if opening is None else np.asarray(opening, float)
    ticks = _by_tick(paths, times, lambda t, x: t < x, lambda at: {f"s{k}": F.sum(F.when(F.col("type") == k, F.exp(-beta * (at - F.col("t")))).otherwise(0.0)) for k in range(d)})
    gaps = [b - a for a, b in zip([0.0, *times], times)]
    steps = F.array(*(F.struct(F.lit(i).alias("tick"), F.lit(float(t)).alias("t"), F.lit(math.exp(-beta * g)).alias("fade")) for i, (t, g) in enumerate(zip(times, gaps))))
    none = F.array(*(F.lit(0.0) for _ in range(d)))
    start = F.array(F.array(*(F.lit(float(x)) for x in z0)))
    step = lambda out, x: F.concat(out, F.array(F.zip_with(F.element_at(out, -1), F.coalesce(F.element_at("ticks", x["tick"]), none), lambda z, s: z * x["fade"] + s)))
    states = ticks.select("path_id", F.slice(F.aggregate(steps, start, step), 2, len(times)).alias("zs"))
    at = states.select("path_id", F.posexplode("zs").alias("i", "z"))
    return at.select("path_id", F.get(F.array(*(F.lit(float(t)) for t in times)), F.col("i")).alias("t"), *(F.get("z", F.lit(k)).alias(f"z{k}") for k in range(d)))


def counts_on_clock(paths: DataFrame, d: int, clock: list[float]) -> DataFrame:
    """(path_id, t, n0..): events of each type at or before each clock time."""
    times = sorted(clock)
    ticks = _by_tick(paths, times, lambda t, x: t <= x, lambda _: {f"c{k}": F.count_if(F.col("type") == k) for k in range(d)})
    grid = F.posexplode(F.array(*(F.lit(float(t)) for t in times))).alias("i", "t")
    upto = lambda k: F.aggregate(F.sequence(F.lit(0), F.col("i")), F.lit(0).cast("long"), lambda n, j: n + F.coalesce(F.get(F.element_at("ticks", j), F.lit(k)), F.lit(0).cast("long")))
    return ticks.select("path_id", "ticks", grid).select("path_id", "t", *(upto(k).alias(f"n{k}") for k in range(d)))


def compensators_on_clock(paths: DataFrame, p: Hawkes, clock: list[float]) -> DataFrame:
    """(path_id, t, type, n, compensator): events of each type at or before each clock time, and the compensator there.

    Every event is added to its first tick once, faded to it; from tick to tick state and counts are carried in closed
    form, so a path costs a row a tick however many events it has.
    """
    times, beta, d = sorted(clock), p.beta, p.d
    cells = lambda at: {f"s{k}": F.sum(F.when(F.col("type") == k, F.exp(-beta * (at - F.col("t")))).otherwise(0.0)) for k in range(d)} | {f"c{k}": F.count_if(F.col("type") == k).cast("double") for k in range(d)}
    ticks = _by_tick(paths, times, lambda t, x: t <= x, cells)
    fades = [math.exp(-beta * (b - a)) for a, b in zip([0.0, *times], times)]
    steps = F.array(*(F.struct(F.lit(i).alias("tick"), F.array(*(F.lit(f) for f in [fade] * d + [1.0] * d)).alias("fade")) for i, fade in enumerate(fades)))
    none = F.array(*(F.lit(0.0) for _ in range(2 * d)))
    faded = lambda z, x: F.zip_with(F.zip_with(z, x["fade"], lambda a, b: a * b), F.coalesce(F.element_at("ticks", x["tick"]), none), lambda a, b: a + b)
    states = ticks.select("path_id", F.slice(F.aggregate(steps, F.array(none), lambda out, x: F.concat(out, F.array(faded(F.element_at(out, -1), x)))), 2, len(times)).alias("zs"))
    at = states.select("path_id", F.posexplode("zs").alias("i", "z")).withColumn("t", F.get(F.array(*(F.lit(float(t)) for t in times)), F.col("i")))
    gone = [F.get("z", F.lit(d + k)) - F.get("z", F.lit(k)) for k in range(d)]
    comp = lambda k: F.lit(float(p.mu[k])) * F.col("t") + sum((F.lit(float(p.a[k, j] / beta)) * gone[j] for j in range(d)), F.lit(0.0))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("type"), F.get("z", F.lit(d + k)).cast("long").alias("n"), comp(k).alias("compensator")) for k in range(d))))
    return at.select("path_id", "t", each.alias("x")).select("path_id", "t", "x.*")


def martingale_increments(on_clock: DataFrame) -> DataFrame:
    """(path_id, t, type, counted, increment): what each type gains from the tick before, and that less its compensator."""
    w = Window.partitionBy("path_id", "type").orderBy("t")
    gain = lambda c: F.col(c) - F.lag(c).over(w)
    rows = on_clock.withColumns({"counted": gain("n"), "increment": (F.col("n") - F.col("compensator")) - F.lag(F.col("n") - F.col("compensator")).over(w)})
    return rows.where("increment is not null").select("path_id", "t", "type", "counted", "increment")


def increment_correlations(increments: DataFrame, d: int, value: str = "increment") -> DataFrame:
    """(first, second, windows, correlation, error): of the increments of two types over the same windows, all paths
    together; the error is that of a sum of martingale differences. NULL where a type never varies."""
    wide = increments.groupBy("path_id", "t").agg(*(F.max(F.when(F.col("type") == k, F.col(value))).cast("double").alias(f"x{k}") for k in range(d)))
    pairs = [(i, j) for i in range(d) for j in range(i + 1, d)]
    means = wide.agg(*(F.avg(f"x{k}") for k in range(d))).first()  # d numbers
    c = [F.col(f"x{k}") - F.lit(m) for k, m in enumerate(means)]
    sums = wide.agg(F.count("*").alias("windows"), *(F.sum(c[i] * c[j]).alias(f"s{i}_{j}") for i in range(d) for j in range(i, d)), *(F.sum(c[i] * c[j] * c[i] * c[j]).alias(f"q{i}_{j}") for i, j in pairs))
    norm = lambda i, j: F.sqrt(F.col(f"s{i}_{i}") * F.col(f"s{j}_{j}"))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("first"), F.lit(j).alias("second"), F.try_divide(F.col(f"s{i}_{j}"), norm(i, j)).alias("correlation"), F.try_divide(F.sqrt(f"q{i}_{j}"), norm(i, j)).alias("error")) for i, j in pairs)))
    return sums.select("windows", each.alias("x")).select("x.first", "x.second", "windows", "x.correlation", "x.error")


def residuals(replayed: DataFrame) -> DataFrame:
    """(path_id, type, n, residual): the compensator between successive events of a type; unit exponential under
    the model."""
    own = F.get("compensators", F.col("type"))
    w = Window.partitionBy("path_id", "type").orderBy("n")
    return replayed.select("path_id", "type", "n", own.alias("c")).select("path_id", "type", "n", (F.col("c") - F.coalesce(F.lag("c").over(w), F.lit(0.0))).alias("residual"))


#: How many ranges of values are ranked side by side.
RANK_BLOCKS = 64


def exponential_ranks(df: DataFrame, value: str, by: list[str], blocks: int = RANK_BLOCKS) -> DataFrame:
    """(by, value, law, rank, n) of every value that is not NULL: the unit exponential law at it, its rank from 1 in its
    group and the size of the group.

    Rows are ranked within ranges of values, after the numbers of rows in the ranges before, so that a group
    is sorted by many tasks. The ranges are of equal probability under the law.
    """
    u = 1 - F.exp(-F.col(value))
    rows = df.select(*by, F.col(value).alias("value"), u.alias("law"), F.greatest(F.lit(0), F.least(F.floor(u * blocks), F.lit(blocks))).alias("_block")).where("value is not null")
    ranges = rows.groupBy(*by, "_block").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(*by, "_block", before.alias("_before"), F.sum("_c").over(Window.partitionBy(*by)).alias("n"))
    ranked = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_block").orderBy("value"))).join(ranges, [*by, "_block"])
    return ranked.select(*by, "value", "law", (F.col("_before") + F.col("_i")).alias("rank"), "n")


def ks_exponential(df: DataFrame, value: str, by: list[str], blocks: int = RANK_BLOCKS) -> DataFrame:
    """(by, n, ks): the Kolmogorov-Smirnov distance to the unit exponential law."""
    d = F.greatest(F.col("rank") / F.col("n") - F.col("law"), F.col("law") - (F.col("rank") - 1) / F.col("n"))
    return exponential_ranks(df, value, by, blocks).groupBy(*by).agg(F.count("*").alias("n"), F.max(d).alias("ks"))


def sample_mean(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Mean and standard error across paths of each column."""
    out = []
    for c in columns:
        out += [F.avg(c).alias(f"{c}_mean"), (F.stddev_samp(c) / F.sqrt(F.count(c))).alias(f"{c}_error")]
    return df.groupBy(*by).agg(*out)


def counts_in_windows(paths: DataFrame, width: float, horizon: float, by: list[str]) -> DataFrame:
    """(by, window, n) for every window of the horizon, empty ones included."""
    windows = int(horizon / width)
    got = paths.where(F.col("t") < windows * width).groupBy(*by, F.floor(F.col("t") / width).alias("window")).count()
    grid = paths.select(*by).distinct().withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(windows - 1).cast("long"))))
    return grid.join(got, [*by, "window"], "left").select(*by, "window", F.coalesce("count", F.lit(0)).alias("n"))


def fano(counts: DataFrame, by: list[str]) -> DataFrame:
    return counts.groupBy(*by).agg(F.try_divide(F.var_samp("n"), F.avg("n")).alias("fano"))


def cluster_sizes(spark: SparkSession, p: Hawkes, founders: int, founder_type: int, seed: int) -> DataFrame:
    """(cluster, size): total progeny, founder included, of independent branching trees."""

    def run(batches):
        for batch in batches:
            out = []
            for c in batch["id"]:
                rng, living, size = seeded(seed, int(c)), np.bincount([founder_type], minlength=p.d), 1
                while living.any():
                    living = rng.poisson(p.gamma @ living)
                    size += int(living.sum())
                out.append((int(c), size))
            yield pd.DataFrame(out, columns=["cluster", "size"])

    return spark.range(founders).mapInPandas(run, "cluster long, size long")


def poisson_paths(spark: SparkSession, rates: list[float], paths: int, horizon: float, seed: int) -> DataFrame:
    """Homogeneous Poisson paths in the same shape as Hawkes ones."""
    return simulate(spark, Hawkes(np.array(rates), np.zeros((len(rates), len(rates))), 1.0), paths, horizon, seed)
