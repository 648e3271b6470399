"""Steps that learn from one table and apply to others, and ways to put them together.

A step is a function of a table; it learns what it needs in one pass of aggregation and returns a function from a table to a table. So what is learned from training rows applies to any others.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gram, models
from .ranks import quantiles

Apply = Callable[[DataFrame], DataFrame]
Step = Callable[[DataFrame], Apply]


def learned(columns: Sequence[str], measures: Callable[[Column], Sequence[Column]], formula: Callable[..., Column]) -> Step:
    """A step that replaces each column by formula(column, *measures), the measures being taken from the training rows."""

    def fit(df: DataFrame) -> Apply:
        found = [m for c in columns for m in measures(F.col(c).cast("double"))]
        row = df.agg(*[m.alias(f"m{i}") for i, m in enumerate(found)]).head()
        k = len(found) // max(1, len(columns))
        return lambda d: d.withColumns({c: formula(F.col(c).cast("double"), *row[i * k : (i + 1) * k]) for i, c in enumerate(columns)})

    return fit


def _by(x: Column, size: float | None) -> Column:
    return x / F.lit(float(size) if size else 1.0)


def standard(columns: Sequence[str]) -> Step:
    """Mean 0 and population deviation 1; a constant column becomes 0."""
    return learned(columns, lambda c: (F.avg(c), F.stddev_pop(c)), lambda x, m, s: _by(x - F.lit(m), s))


def between(columns: Sequence[str], low: float = 0.0, high: float = 1.0) -> Step:
    """From low to high over the training rows; others may lie beyond."""
    return learned(columns, lambda c: (F.min(c), F.max(c)), lambda x, a, b: _by(x - F.lit(a), (b or 0) - (a or 0)) * (high - low) + low)


def by_largest(columns: Sequence[str]) -> Step:
    return learned(columns, lambda c: (F.max(F.abs(c)),), lambda x, m: _by(x, m))


def robust(columns: Sequence[str], low: float = 0.25, high: float = 0.75, accuracy: int = 100_000) -> Step:
    """Median 0 and the range between two quantiles 1; quantiles by summaries of bounded size, to 1/accuracy of the ranks."""
    return learned(columns, lambda c: (F.percentile_approx(c, [low, 0.5, high], accuracy),), lambda x, q: _by(x - F.lit(q[1]), q[2] - q[0]))


def filled(columns: Sequence[str], how: str = "mean", value: float = 0.0) -> Step:
    """Nulls become the training rows' mean, or a value (how: constant)."""
    if how == "constant":
        return applied(lambda d: d.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in columns}))
    return learned(columns, lambda c: (F.avg(c),), lambda x, m: F.coalesce(x, F.lit(m)))


def applied(f: Apply) -> Step:
    """A step that learns nothing."""
    return lambda df: f


def powers(columns: Sequence[str], degree: int = 2) -> Step:
    """Further columns c_2, c_3, ...: powers up to degree."""
    return applied(lambda d: d.withColumns({f"{c}_{k}": F.pow(c, F.lit(float(k))) for c in columns for k in range(2, degree + 1)}))


def indicators(column: str, most: int = 1000) -> Step:
    """Columns column=value, 1 or 0, for the values of the training rows (most at the most, else a ValueError); a value that these don't have is 0 in all."""

    def fit(df: DataFrame) -> Apply:
        values = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
        if len(values) > most:
            raise ValueError(f"{column} has more than {most} values")
        return lambda d: d.withColumns({f"{column}={v}": F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)) for v in values})

    return fit


def constant(name: str = "one", value: float = 1.0) -> Step:
    return applied(lambda d: d.withColumn(name, F.lit(value)))


def pipeline(*steps: Step) -> Step:
    """Each step learns from what the steps before make of the training rows."""

    def fit(df: DataFrame) -> Apply:
        done: list[Apply] = []
        for step in steps:
            done.append(step(df))
            df = done[-1](df)

        def apply(d: DataFrame) -> DataFrame:
            for f in done:
                d = f(d)
            return d

        return apply

    return fit


def union(**steps: tuple[Sequence[str], Step]) -> Step:
    """Each step, given with the columns that it makes, learns from the rows as they are; its columns come out beside the rows' own as name_column. The steps' columns are made side by side in one projection each, without joins."""

    def fit(df: DataFrame) -> Apply:
        done = {name: (columns, step(df)) for name, (columns, step) in steps.items()}

        def apply(d: DataFrame) -> DataFrame:
            own = d.columns
            for name, (columns, f) in done.items():
                kept = d.select("*", *[F.col(c).alias(f"_was_{c}") for c in own])
                made = f(kept)
                d = made.select(*[F.col(f"_was_{c}").alias(c) for c in own], *[c for c in d.columns if c not in own], *[F.col(c).alias(f"{name}_{c}") for c in columns])
            return d

        return apply

    return fit


def by_columns(*steps: tuple[Sequence[str], Step], rest: str = "keep") -> Step:
    """Each step for its own columns, learned from the rows as they are; the other columns are kept or dropped."""

    def fit(df: DataFrame) -> Apply:
        done = [step(df) for _, step in steps]
        named = [c for columns, _ in steps for c in columns]

        def apply(d: DataFrame) -> DataFrame:
            others = [c for c in d.columns if c not in named]
            for f in done:
                d = f(d)
            return d if rest == "keep" else d.drop(*others)

        return apply

    return fit


def columns_of(df: DataFrame, pattern: str | None = None, kinds: Sequence[str] | None = None) -> list[str]:
    """Names of columns that match a pattern and have one of the types."""
    import re

    return [c for c, k in df.dtypes if (pattern is None or re.search(pattern, c)) and (kinds is None or k in kinds)]


def linear(columns: Sequence[str], target: str, out: str = "prediction", alpha: float = 0.0) -> Step:
    """Least squares, or ridge with alpha; rows with nulls are not learned from."""

    def fit(df: DataFrame) -> Apply:
        df = df.na.drop(subset=[*columns, target])
        m = models.least_squares(df, target, columns) if not alpha else gram.ridge(gram.moments(df, columns, target), alpha)
        return lambda d: d.withColumn(out, m.predict(columns))

    return fit


def constant_prediction(target: str, how: str = "mean", out: str = "prediction", value: float | None = None) -> Step:
    """The training rows' mean, median or a quantile of the target (how a number from 0 to 1), or value (how: constant), for every row."""

    def fit(df: DataFrame) -> Apply:
        y = F.col(target).cast("double")
        share = 0.5 if how == "median" else how
        v = value if how == "constant" else df.agg(F.avg(y)).head()[0] if how == "mean" else quantiles(df, target, [share])[0]
        return lambda d: d.withColumn(out, F.lit(v))

    return fit


def transformed_target(step: Callable[[str], Step], target: str, forward: Callable[[Column], Column], back: Callable[[Column], Column], out: str = "prediction") -> Step:
    """A regressor (a step for a target's name) of forward(target); predictions are taken back."""

    def fit(df: DataFrame) -> Apply:
        f = step("_target")(df.withColumn("_target", forward(F.col(target))))
        return lambda d: f(d).withColumn(out, back(F.col(out)))

    return fit
