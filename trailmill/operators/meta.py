"""Models made of models: votes, stacks, bags, classes against classes, chains."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .compose import Apply, Step, linear
from .model_selection import cross_predict, share_of

#: A regressor for the named target, whose predictions go to the named column.
Make = Callable[[str, str], Step]


def classes_of(df: DataFrame, label: str, most: int = 1000) -> list:
    found = [r[0] for r in df.select(label).filter(F.col(label).isNotNull()).distinct().orderBy(label).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{label} has more than {most} classes")
    return found


def _all(df: DataFrame, steps: Sequence[Step], made: Sequence[str], out: str, combine: Callable[[list], object]) -> Apply:
    done = [s(df) for s in steps]

    def apply(d: DataFrame) -> DataFrame:
        for f in done:
            d = f(d)
        return d.withColumn(out, combine([F.col(c) for c in made])).drop(*made)

    return apply


def voting(makes: Sequence[Make], target: str, weights: Sequence[float] | None = None, out: str = "prediction") -> Step:
    """The weighted mean of several regressors' predictions."""
    w = [float(x) for x in weights or [1.0] * len(makes)]
    names = [f"_vote_{i}" for i in range(len(makes))]
    return lambda df: _all(df, [m(target, n) for m, n in zip(makes, names, strict=True)], names, out, lambda cols: sum((c * x for c, x in zip(cols, w, strict=True)), F.lit(0.0)) / sum(w))


def stacking(makes: Sequence[Make], target: str, fold: str = "fold", out: str = "prediction") -> Step:
    """A linear model of several regressors' predictions, learned from predictions of rows by models of the other folds; the regressors then learn from all rows."""
    names = [f"_stack_{i}" for i in range(len(makes))]

    def fit(df: DataFrame) -> Apply:
        held = df
        for m, n in zip(makes, names, strict=True):
            held = cross_predict(m(target, n), held, fold)
        top = linear(names, target, out)(held)
        done = [m(target, n)(df) for m, n in zip(makes, names, strict=True)]

        def apply(d: DataFrame) -> DataFrame:
            for f in done:
                d = f(d)
            return top(d).drop(*names)

        return apply

    return fit


def bagging(make: Make, target: str, key: str, n: int = 10, share: float = 0.5, out: str = "prediction") -> Step:
    """The mean of n models, each learned from a share of the rows drawn by digest of key, without repetition."""
    names = [f"_bag_{i}" for i in range(n)]

    def one(i: int) -> Step:
        return lambda df: make(target, names[i])(df.filter(share_of(F.col(key), i) < share))

    return lambda df: _all(df, [one(i) for i in range(n)], names, out, lambda cols: sum(cols[1:], cols[0]) / n)


def _largest(cols: list, classes: Sequence) -> object:
    """The class of the largest column, ties to the first."""
    best, name = cols[0], F.lit(classes[0])
    for c, k in zip(cols[1:], classes[1:], strict=True):
        name, best = F.when(c > best, F.lit(k)).otherwise(name), F.greatest(best, c)
    return name


def one_against_rest(make: Make, label: str, out: str = "predicted") -> Step:
    """A model of each class's indicator; the class of the largest prediction."""

    def fit(df: DataFrame) -> Apply:
        kinds = classes_of(df, label)
        names = [f"_class_{i}" for i in range(len(kinds))]
        steps = [lambda d, k=k, n=n: make("_hit", n)(d.withColumn("_hit", (F.col(label) == F.lit(k)).cast("double"))) for k, n in zip(kinds, names, strict=True)]
        return _all(df, steps, names, out, lambda cols: _largest(cols, kinds))

    return fit


def one_against_one(make: Make, label: str, out: str = "predicted") -> Step:
    """A model for each pair of classes, learned from their rows; the class with most wins, ties to the first."""

    def fit(df: DataFrame) -> Apply:
        kinds = classes_of(df, label)
        duels = list(itertools.combinations(range(len(kinds)), 2))
        names = [f"_duel_{i}_{j}" for i, j in duels]
        steps = [lambda d, i=i, j=j, n=n: make("_hit", n)(d.filter(F.col(label).isin(kinds[i], kinds[j])).withColumn("_hit", (F.col(label) == F.lit(kinds[i])).cast("double"))) for (i, j), n in zip(duels, names, strict=True)]

        def wins(cols: list) -> object:
            score = [sum((((c > 0.5) if k == i else (c <= 0.5)).cast("int") for (i, j), c in zip(duels, cols, strict=True) if k in (i, j)), F.lit(0)) for k in range(len(kinds))]
            return _largest(score, kinds)

        return _all(df, steps, names, out, wins)

    return fit


def output_code(make: Make, label: str, code: dict[object, Sequence[int]], out: str = "predicted") -> Step:
    """A model for each bit of the classes' code words; the class whose word is nearest to the predictions (squared distance, ties to the first)."""
    kinds, n = sorted(code), len(next(iter(code.values())))
    names = [f"_bit_{i}" for i in range(n)]

    def bit(i: int) -> Step:
        ones = [k for k in kinds if code[k][i]]
        return lambda d: make("_hit", names[i])(d.withColumn("_hit", F.col(label).isin(*ones).cast("double")))

    return lambda df: _all(df, [bit(i) for i in range(n)], names, out, lambda cols: _largest([-sum(((c - float(b)) * (c - float(b)) for c, b in zip(cols, code[k], strict=True)), F.lit(0.0)) for k in kinds], kinds))


def chain(make: Callable[[Sequence[str], str, str], Step], columns: Sequence[str], targets: Sequence[str], prefix: str = "predicted_") -> Step:
    """A model for each target in turn, of the columns and the targets before it: true ones for learning, predicted ones after."""

    def fit(df: DataFrame) -> Apply:
        done = [make([*columns, *targets[:i]], t, f"{prefix}{t}")(df) for i, t in enumerate(targets)]

        def apply(d: DataFrame) -> DataFrame:
            d = d.withColumns({f"_true_{t}": F.col(t) for t in targets if t in d.columns})
            for f, t in zip(done, targets, strict=True):
                d = f(d).withColumn(t, F.col(f"{prefix}{t}"))
            held = [t for t in targets if f"_true_{t}" in d.columns]
            return d.withColumns({t: F.col(f"_true_{t}") for t in held}).drop(*[f"_true_{t}" for t in held])

        return apply

    return fit


def each_target(make: Make, targets: Sequence[str], prefix: str = "predicted_") -> Step:
    """A model of its own for each target."""

    def fit(df: DataFrame) -> Apply:
        done = [make(t, f"{prefix}{t}")(df) for t in targets]

        def apply(d: DataFrame) -> DataFrame:
            for f in done:
                d = f(d)
            return d

        return apply

    return fit
