"""Named metrics over event logs: counts that are summed by sequence, and ratios that follow from them, so that they hold for all sequences together too."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .events import share


@dataclass
class Metric:
    name: str
    help: str
    needs: tuple[str, ...]
    #: An aggregation over the log, or with needs a formula of their columns.
    formula: Callable[..., Column]


class Metrics:
    """A registry: counts and formulas by name; computing some takes what they need in one aggregation."""

    def __init__(self) -> None:
        self.known: dict[str, Metric] = {}

    def register(self, name: str, formula: Callable[..., Column], *, needs: Iterable[str] = (), help: str = "") -> None:  # noqa: A002
        """Add a metric; those that it needs must be known (KeyError). A name that is known is replaced."""
        needs = tuple(needs)
        for n in needs:
            self.known[n]
        self.known[name] = Metric(name, help, needs, formula)

    def names(self) -> list[str]:
        return list(self.known)

    def listed(self, spark) -> DataFrame:  # noqa: ANN001
        """(name, help, needs) of all metrics."""
        return spark.createDataFrame([(m.name, m.help, list(m.needs)) for m in self.known.values()], "name string, help string, needs array<string>")

    def _order(self, names: Iterable[str]) -> list[Metric]:
        out: dict[str, Metric] = {}

        def visit(n: str) -> None:
            for k in self.known[n].needs:
                visit(k)
            out.setdefault(n, self.known[n])

        for n in names:
            visit(n)
        return list(out.values())

    def compute(self, log: DataFrame, names: Iterable[str] | None = None, *, overall: bool = True, by: str = "seq") -> DataFrame:
        """by and the metrics of each sequence, and of all together as OVERALL: counts are added up, formulas taken of the sums."""
        names = list(names or self.known)
        order = self._order(names)
        counts = [m for m in order if not m.needs]
        per = log.groupBy(by).agg(*[m.formula().alias(m.name) for m in counts])
        if overall:
            per = per.unionByName(per.agg(*[F.sum(m.name).alias(m.name) for m in counts]).select(F.lit("OVERALL").alias(by), *[m.name for m in counts]))
        for m in order:
            if m.needs:
                per = per.withColumn(m.name, m.formula(*[F.col(n) for n in m.needs]))
        return per.select(by, *names)


def standard() -> Metrics:
    """The counts and ratios of a log of MATCH, SWITCH, FP and MISS rows (type, oid, hid, d)."""
    m, kind = Metrics(), F.col("type")
    found = kind.isin("MATCH", "SWITCH", "TRANSFER", "ASCEND", "MIGRATE")
    m.register("num_frames", lambda: F.count_distinct("frame"), help="frames")
    m.register("num_matches", lambda: F.count_if(kind == "MATCH"), help="matches that are no switches")
    m.register("num_switches", lambda: F.count_if(kind == "SWITCH"), help="switches of the hypothesis")
    m.register("num_false_positives", lambda: F.count_if(kind == "FP"), help="hypotheses without an object")
    m.register("num_misses", lambda: F.count_if(kind == "MISS"), help="objects without a hypothesis")
    m.register("num_objects", lambda: F.count_if((found | (kind == "MISS")) & F.col("oid").isNotNull()), help="objects over all frames")
    m.register("num_detections", lambda: F.count_if(kind.isin("MATCH", "SWITCH")), help="matches and switches")
    m.register("sum_d", lambda: F.coalesce(F.sum(F.when(kind.isin("MATCH", "SWITCH"), F.col("d"))), F.lit(0.0)), help="distances of matches and switches")
    m.register("mota", lambda a, b, c, n: 1 - share(a + b + c, n), needs=("num_misses", "num_switches", "num_false_positives", "num_objects"), help="accuracy")
    m.register("motp", share, needs=("sum_d", "num_detections"), help="mean distance")
    m.register("precision", lambda d, f: share(d, d + f), needs=("num_detections", "num_false_positives"), help="detections of hypotheses")
    m.register("recall", share, needs=("num_detections", "num_objects"), help="detections of objects")
    return m
