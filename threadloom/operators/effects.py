"""Two-way fixed-effects fits from cross products that add up over communities.

A model's design is [treatments, month indicators] with the effects of a community taken out of its
own rows.  The cross products of that are a small square matrix per community, whatever the number
of communities; tasks add them up, the sums are solved, and a second pass adds up the squared scores
of the communities for the clustered covariance.  So no task holds a panel and no design is dense.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import Scratch

UNITS = "unit string, trend boolean, month array<int>, time array<double>, y array<double>, w array<double>, x array<double>"
OMITTED_A_PASS = 20_000  # communities left out in one pass; more take more passes


def unit_rows(long: DataFrame, by: Sequence[str], scratch: Scratch, trend: Column | None = None) -> DataFrame:
    """One row per model and community, with its months in arrays; a community has at most one row per calendar month.

    ``long`` has ``by``, subreddit, ``at`` (month number), ``time``, ``y``, ``w`` and ``x``, an array of treatments.
    """
    cell = F.sort_array(F.collect_list(F.struct("at", "time", "y", "w", "x")))
    rows = long.groupBy(*by, F.col("subreddit").alias("unit")).agg((F.max(trend) if trend is not None else F.lit(False)).alias("trend"), cell.alias("cells"))
    parts = [F.col("cells.at").alias("month"), *[F.col(f"cells.{c}").alias(c) for c in ("time", "y", "w")], F.flatten("cells.x").alias("x")]
    return scratch.save(rows.select(*by, "unit", "trend", *parts), "units")


def cross_products(row, t: int, first: int, months: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(weighted cross products of [y, treatments, months] without the community's effects, rows per month, means, carried columns)."""
    month = np.asarray(row.month, dtype=np.int64) - first
    z = np.zeros((len(month), 1 + t + months))
    z[:, 0] = row.y
    if t:
        z[:, 1 : 1 + t] = np.asarray(row.x, dtype=float).reshape(len(month), t)
    z[np.arange(len(month)), 1 + t + month] = 1.0
    w = np.asarray(row.w, dtype=float)
    mean = w @ z / w.sum()
    z = z - mean
    if row.trend:
        time = np.asarray(row.time, dtype=float)
        time = time - w @ time / w.sum()
        spread = w @ (time * time)
        if spread > 0:
            z = z - np.outer(time, (w * time) @ z / spread)
    return z.T @ (z * w[:, None]), np.bincount(month, minlength=months).astype(float), mean


def inverse(a: np.ndarray) -> np.ndarray:
    """Generalised inverse of a cross-product matrix, scaled so that columns of any size count alike."""
    size = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    return np.linalg.pinv(a / np.outer(size, size), rcond=1e-10, hermitian=True) / np.outer(size, size)


class Fit:
    """Sums over communities of one model and what follows from them."""

    def __init__(self, t: int, months: int):
        k = 1 + t + months
        self.t, self.months, self.month0 = t, months, 0
        self.products, self.rows, self.scores = np.zeros((k, k)), np.zeros(months), np.zeros((t + months, t + months))
        self.units = self.trends = 0
        self.health, self.healthy, self.other = np.zeros(k), 0, np.zeros(k)  # sums of the means of health communities and of the others
        self.first, self.first_mean, self.first_health = None, np.zeros(k), False

    def add(self, unit: str, products: np.ndarray, rows: np.ndarray, mean: np.ndarray, trend: bool, health: bool) -> None:
        self.products += products
        self.rows += rows
        self.units += 1
        self.trends += bool(trend)
        if health:
            self.health += mean
            self.healthy += 1
        else:
            self.other += mean
        if self.first is None or unit < self.first:
            self.first, self.first_mean, self.first_health = unit, mean, health

    def merge(self, other: Fit) -> None:
        for name in ("products", "rows", "scores", "health", "other"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        self.units, self.trends, self.healthy = self.units + other.units, self.trends + other.trends, self.healthy + other.healthy
        if other.first is not None and (self.first is None or other.first < self.first):
            self.first, self.first_mean, self.first_health = other.first, other.first_mean, other.first_health

    def packed(self) -> bytes:
        import pickle

        return pickle.dumps(self.__dict__)

    @classmethod
    def unpacked(cls, data: bytes) -> Fit:
        import pickle

        fit = cls(0, 0)
        fit.__dict__.update(pickle.loads(data))
        return fit

    def solve(self) -> np.ndarray:
        return inverse(self.products[1:, 1:]) @ self.products[1:, 0]

    @property
    def n(self) -> int:
        return int(self.rows.sum())

    @property
    def n_months(self) -> int:
        return int((self.rows > 0).sum())

    def columns(self, t: int) -> int:
        """Columns of the dense design with ``t`` treatments; redundant ones count."""
        return t + self.units + self.n_months - 1 + (self.units if self.trends else 0)

    def correction(self, t: int) -> float:
        return self.units / max(1, self.units - 1) * (self.n - 1) / max(1, self.n - self.columns(t))

    def effects(self, used: Sequence[int], whole_bins: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(coefficients, clustered covariance) of the used treatments.

        With ``whole_bins`` the treatments sum to the health communities' own effects, so they are not
        identified; the result is then that of the least-norm solution of the dense design.
        """
        bread, theta, used = inverse(self.products[1:, 1:]), self.solve(), list(used)
        left, beta = bread[used], theta[used]
        if whole_bins:
            # the null direction is 1 on the treatments and -1 on the effects of health communities, or, when the
            # first community, which has no column of its own, is one, -1 on the constant and 1 on the other communities
            across, count = (self.health - self.healthy * self.first_mean, self.healthy) if not self.first_health else (-self.other + (self.units - self.healthy) * self.first_mean + self.first_mean, self.units - self.healthy + 1)
            ones = np.zeros(self.t + self.months)
            ones[used] = 1.0
            along = ones + across[1:]
            shift = across[0]
            if self.first_health:  # months are measured from the first one in the dense design
                month = self.t + int(np.flatnonzero(self.rows)[0])
                along[month] -= 1.0
            size = len(used) + count
            beta = beta - (along @ theta - shift) / size
            left = left - np.outer(np.ones(len(used)), along @ bread) / size
        return beta, left @ self.scores @ left.T * self.correction(len(used))


def gather(units: DataFrame, by: Sequence[str], t: int, first: int, months: int, healthy: Callable | None = None, solved: DataFrame | None = None) -> DataFrame:
    """``by, part``: partial fits of the tasks, merged per model; with ``solved`` (by, theta) the scores and nothing else are summed."""
    names, scoring = list(by), solved is not None
    schema = ", ".join(f"{c} {dict(units.dtypes)[c]}" for c in names) + ", part binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fits: dict[tuple, Fit] = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                key = tuple(getattr(row, c) for c in names)
                fit = fits.get(key)
                if fit is None:
                    fit = fits[key] = Fit(t, months)
                    fit.month0 = first
                products, rows, mean = cross_products(row, t, first, months)
                if not scoring:
                    fit.add(row.unit, products, rows, mean, row.trend, bool(healthy and healthy(row)))
                else:
                    score = products[1:, 0] - products[1:, 1:] @ np.asarray(row.theta, dtype=float)
                    fit.scores += np.outer(score, score)
        if fits:
            yield pd.DataFrame([(*key, fit.packed()) for key, fit in fits.items()], columns=[*names, "part"])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [Fit.unpacked(p) for p in pdf["part"]]
        for part in parts[1:]:
            parts[0].merge(part)
        return pd.DataFrame([(*(pdf[c].iloc[0] for c in names), parts[0].packed())], columns=[*names, "part"])

    rows = units.join(solved, names) if scoring else units
    return rows.mapInPandas(run, schema).groupBy(*names).applyInPandas(merged, schema)


def month_range(units: DataFrame) -> tuple[int, int]:
    """(first month, number of months): two scalars."""
    ends = units.agg(F.min(F.array_min("month")).alias("a"), F.max(F.array_max("month")).alias("b")).first()
    return (ends.a, ends.b - ends.a + 1) if ends.a is not None else (0, 1)


def fit_models(long: DataFrame, by: Sequence[str], t: int, report: Callable[[tuple, Fit], list[tuple]], schema: str, trend: Column | None = None, healthy: Callable | None = None) -> DataFrame:
    """Fits every model of ``by`` and returns the rows that ``report(key, fit)`` makes of each."""
    scratch = Scratch(long.sparkSession)
    units = unit_rows(long, by, scratch, trend)
    first, months = month_range(units)
    names = list(by)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(theta=[Fit.unpacked(p).solve().tolist() for p in batch["part"]])

    keys = ", ".join(f"{c} {dict(units.dtypes)[c]}" for c in names)
    sums = gather(units, by, t, first, months, healthy)
    solved = scratch.save(sums.mapInPandas(solve, f"{keys}, part binary, theta array<double>"), "solved")
    scores = gather(units, by, t, first, months, solved=solved.select(*names, "theta"))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                fit = Fit.unpacked(row.part)
                fit.scores = Fit.unpacked(row.scored).scores
                out += report(tuple(getattr(row, c) for c in names), fit)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return solved.select(*names, "part").join(scores.withColumnRenamed("part", "scored"), names).mapInPandas(finish, schema)


def omitting_each(long: DataFrame, report: Callable[[str, float, float], tuple], schema: str) -> DataFrame:
    """The first treatment's effect and its variance without each community in turn.

    Cross products are subtracted, not fitted anew.  The solutions of a fixed number of omitted
    communities are broadcast at a time; every other community adds its squared score to each.
    """
    spark, scratch = long.sparkSession, Scratch(long.sparkSession)
    units = unit_rows(long.withColumn("model", F.lit("all")), ["model"], scratch)
    t = 1
    first, months = month_range(units)
    whole = gather(units, ["model"], t, first, months).select("part").first()
    if whole is None:
        return spark.createDataFrame([], schema)
    total = Fit.unpacked(bytes(whole.part))

    def without(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                products, rows, _ = cross_products(row, t, first, months)
                rest = Fit(t, months)
                rest.products, rest.rows, rest.units = total.products - products, total.rows - rows, total.units - 1
                bread = inverse(rest.products[1:, 1:])
                if rest.units:
                    out.append((row.unit, (bread @ rest.products[1:, 0]).tolist(), bread[0].tolist(), rest.correction(t)))
            yield pd.DataFrame(out, columns=["omitted", "theta", "bread", "correction"])

    solved = scratch.save(units.mapInPandas(without, "omitted string, theta array<double>, bread array<double>, correction double"), "omitted")
    found, block = [], []

    def search(part: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(([r.omitted for r in part], np.array([r.theta for r in part]), np.array([r.bread for r in part])))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, theta, bread = shared.value
            place = {name: k for k, name in enumerate(names)}
            sums = np.zeros(len(names))
            for batch in batches:
                for row in batch.itertuples(index=False):
                    products, _, _ = cross_products(row, t, first, months)
                    score = bread @ products[1:, 0] - ((bread @ products[1:, 1:]) * theta).sum(axis=1)
                    if row.unit in place:
                        score[place[row.unit]] = 0.0
                    sums += score * score
            yield pd.DataFrame({"omitted": names, "squares": sums})

        return units.mapInPandas(run, "omitted string, squares double").groupBy("omitted").agg(F.sum("squares").alias("squares"))

    for row in solved.toLocalIterator():
        block.append(row)
        if len(block) == OMITTED_A_PASS:
            found.append(scratch.save(search(block), "squares"))
            block = []
    if block or not found:
        found.append(search(block))
    squares = found[0]
    for part in found[1:]:
        squares = squares.unionByName(part)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [report(r.omitted, r.estimate, r.variance) for r in batch.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    joined = solved.join(squares, "omitted").select("omitted", F.col("theta")[0].alias("estimate"), (F.col("squares") * F.col("correction")).alias("variance"))
    return joined.mapInPandas(finish, schema)
