"""Made-up tables by rule: every value is a function of the row's number and a seed, so any partition can be made again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, *of: Column) -> Column:
    """A number from 0 up to 1 by hash."""
    return (F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(seed: int, *of: Column) -> Column:
    """A standard normal number, by two uniform ones."""
    return F.sqrt(-2 * F.ln(uniform(2 * seed + 1, *of))) * F.cos(2 * F.pi() * uniform(2 * seed + 2, *of))


def blobs(spark: SparkSession, n: int, *, centres: int = 3, dim: int = 2, spread: float = 1.0, box: float = 10.0, seed: int = 0) -> DataFrame:
    """id, v and label: normal clouds around uniform centres."""
    label = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(centres)).cast("int")
    at = [(uniform(seed + 1, F.col("label"), F.lit(i)) * 2 - 1) * box + normal(seed + 2, F.col("id"), F.lit(i)) * spread for i in range(dim)]
    return spark.range(n).withColumn("label", label).select("id", F.array(*at).alias("v"), "label")


def regression(spark: SparkSession, n: int, *, dim: int = 5, informative: int = 3, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """id, x0, x1, ... and y: a linear function of the first informative columns (weights 1, 2, 3, ...)."""
    cols = {f"x{i}": normal(seed + 1, F.col("id"), F.lit(i)) for i in range(dim)}
    y = sum((F.col(f"x{i}") * (i + 1) for i in range(informative)), F.lit(0.0)) + noise * normal(seed + 2, F.col("id"))
    return spark.range(n).withColumns(cols).withColumn("y", y)


def classification(spark: SparkSession, n: int, *, dim: int = 5, flip: float = 0.01, seed: int = 0) -> DataFrame:
    """id, x0, x1, ... and y: the side of a plane, with a share of labels flipped."""
    side = (F.col("y") > 0).cast("int")
    return regression(spark, n, dim=dim, seed=seed).withColumn("y", F.when(uniform(seed + 5, F.col("id")) < flip, 1 - side).otherwise(side))


def moons(spark: SparkSession, n: int, *, noise: float = 0.1, seed: int = 0) -> DataFrame:
    """id, v and label: two interleaving half circles."""
    label, a = F.pmod("id", F.lit(2)).cast("int"), uniform(seed, F.col("id")) * F.pi()
    x = F.when(label == 0, F.cos(a)).otherwise(1 - F.cos(a)) + noise * normal(seed + 1, F.col("id"))
    y = F.when(label == 0, F.sin(a)).otherwise(0.5 - F.sin(a)) + noise * normal(seed + 2, F.col("id"))
    return spark.range(n).select("id", F.array(x, y).alias("v"), label.alias("label"))


def circles(spark: SparkSession, n: int, *, factor: float = 0.5, noise: float = 0.05, seed: int = 0) -> DataFrame:
    """id, v and label: a circle within a circle."""
    label, a = F.pmod("id", F.lit(2)).cast("int"), uniform(seed, F.col("id")) * 2 * F.pi()
    r = F.when(label == 0, 1.0).otherwise(factor)
    return spark.range(n).select("id", F.array(r * F.cos(a) + noise * normal(seed + 1, F.col("id")), r * F.sin(a) + noise * normal(seed + 2, F.col("id"))).alias("v"), label.alias("label"))


def digest(name: str, *of: Column) -> Column:
    """A number from 0 up to 1 by the MD5 digest of a name and values: the same in any system."""
    text = F.concat_ws(":", F.lit(name), *[c.cast("string") for c in of])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def digest_normal(name: str, *of: Column) -> Column:
    """A standard normal number from two of digest()."""
    return F.sqrt(-2 * F.ln(1 - digest(name + "a", *of))) * F.cos(2 * F.pi() * digest(name + "b", *of))


#: Where rows come from: a session, for rows numbered from 0, or a table whose column id (or i and j) numbers them.
Source = SparkSession | DataFrame


def _ids(source: Source, n: int) -> DataFrame:
    return source.select("id") if isinstance(source, DataFrame) else source.range(n)


def _cells(source: Source, rows: int, columns: int) -> DataFrame:
    if isinstance(source, DataFrame):
        return source.select("i", "j")
    return source.range(rows).withColumnRenamed("id", "i").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))


def _table(source: Source, n: int, dim: int, draw: str = "uniform", name: str = "x") -> DataFrame:
    one = digest if draw == "uniform" else digest_normal
    return _ids(source, n).withColumns({f"x{i}": one(f"{name}{i}", F.col("id")) for i in range(dim)})


def friedman(source: Source, n: int = 0, kind: int = 1, noise: float = 0.0) -> DataFrame:
    """id, x0, ... and y by one of three nonlinear formulas: of five of ten uniform columns, or of an alternating current's impedance or phase."""
    x = [F.col(f"x{i}") for i in range(10)]
    df = _table(source, n, 10 if kind == 1 else 4)
    if kind == 1:
        y = 10 * F.sin(F.pi() * x[0] * x[1]) + 20 * (x[2] - 0.5) * (x[2] - 0.5) + 10 * x[3] + 5 * x[4]
    else:
        df = df.withColumns({"x0": x[0] * 100, "x1": (x[1] * 520 + 40) * F.pi(), "x3": x[3] * 10 + 1})
        part = x[1] * x[2] - 1 / (x[1] * x[3])
        y = F.sqrt(x[0] * x[0] + part * part) if kind == 2 else F.atan(part / x[0])
    return df.withColumn("y", y + (noise * digest_normal("noise", F.col("id")) if noise else 0.0))


def s_curve(source: Source, n: int = 0) -> DataFrame:
    """id, x, y, z on an S-shaped sheet, and t, the place along it."""
    t = 3 * F.pi() * (digest("t", F.col("id")) - 0.5)
    return _ids(source, n).withColumn("t", t).select("id", F.sin("t").alias("x"), (2 * digest("y", F.col("id"))).alias("y"), (F.signum("t") * (F.cos("t") - 1)).alias("z"), "t")


def swiss_roll(source: Source, n: int = 0) -> DataFrame:
    """id, x, y, z on a rolled sheet, and t, the place along it."""
    t = 1.5 * F.pi() * (1 + 2 * digest("t", F.col("id")))
    return _ids(source, n).withColumn("t", t).select("id", (F.col("t") * F.cos("t")).alias("x"), (21 * digest("y", F.col("id"))).alias("y"), (F.col("t") * F.sin("t")).alias("z"), "t")


def hastie(source: Source, n: int = 0) -> DataFrame:
    """id, ten normal columns and y: 1 where their squares sum to over 9.34 (the median of that sum), else -1."""
    df = _table(source, n, 10, "normal")
    return df.withColumn("y", F.when(sum(F.col(f"x{i}") * F.col(f"x{i}") for i in range(10)) > 9.34, 1.0).otherwise(-1.0))


def sparse_uncorrelated(source: Source, n: int = 0, dim: int = 10) -> DataFrame:
    """id, normal columns and y: x0 + 2 x1 - 2 x2 - 1.5 x3 and normal noise."""
    return _table(source, n, dim, "normal").withColumn("y", F.expr("x0 + 2 * x1 - 2 * x2 - 1.5 * x3") + digest_normal("noise", F.col("id")))


def gaussian_quantiles(source: Source, n: int = 0, dim: int = 2, classes: int = 3) -> DataFrame:
    """id, normal columns and y: the class by the squared length's place among equal shares of the chi-squared law with 2 columns (others by rank are not made)."""
    if dim != 2:
        raise ValueError("only two columns")
    df = _table(source, n, 2, "normal")
    share = 1 - F.exp(-(F.col("x0") * F.col("x0") + F.col("x1") * F.col("x1")) / 2)
    return df.withColumn("y", F.least(F.floor(share * classes), F.lit(classes - 1)).cast("int"))


def checkerboard(source: Source, rows: int = 0, columns: int = 0, parts: tuple[int, int] = (3, 4), low: float = 10.0, high: float = 100.0) -> DataFrame:
    """(i, j, x, row_part, column_part): a matrix that is constant, but for noise, in each pair of a row's and a column's part."""
    df = _cells(source, rows, columns)
    a, b = F.floor(digest("row", F.col("i")) * parts[0]).cast("int"), F.floor(digest("column", F.col("j")) * parts[1]).cast("int")
    df = df.withColumns({"row_part": a, "column_part": b})
    return df.select("i", "j", (low + (high - low) * digest("cell", F.col("row_part"), F.col("column_part")) + digest_normal("noise", F.col("i"), F.col("j"))).alias("x"), "row_part", "column_part")


def biclusters(source: Source, rows: int = 0, columns: int = 0, parts: int = 3, low: float = 10.0, high: float = 100.0) -> DataFrame:
    """(i, j, x, row_part, column_part): blocks where a row and a column have the same part, and noise elsewhere."""
    df = checkerboard(source, rows, columns, (parts, parts), low, high)
    noise = digest_normal("noise", F.col("i"), F.col("j"))
    return df.withColumn("x", F.when(F.col("row_part") == F.col("column_part"), F.col("x")).otherwise(noise))


def low_rank(source: Source, rows: int = 0, columns: int = 0, rank: int = 3) -> DataFrame:
    """(i, j, x): the product of two normal matrices of that rank, with falling weights 1, 1/2, 1/3, ..."""
    df = _cells(source, rows, columns)
    return df.select("i", "j", sum((digest_normal(f"u{k}", F.col("i")) * digest_normal(f"v{k}", F.col("j")) / (k + 1) for k in range(rank)), F.lit(0.0)).alias("x"))


def multilabel(source: Source, n: int = 0, classes: int = 5, words: int = 20, length: int = 30) -> DataFrame:
    """id, labels (array) and counts (array, one a word): each class is drawn with a probability of its own, and each word's count is that of draws from the classes' words."""
    c = [F.when(digest(f"class{k}", F.col("id")) < (k + 1) / (classes + 1), F.lit(k)) for k in range(classes)]
    df = _ids(source, n).withColumn("labels", F.array_compact(F.array(*c)))
    picks = [F.floor(digest(f"word{w}", F.col("id")) * words).cast("int") for w in range(length)]
    first = F.coalesce(F.try_element_at("labels", F.lit(1)), F.lit(0)) * (words // classes)
    # both are bound as the variable of a lambda: as expressions they would be made anew for every word, and with them all digests
    drawn = F.transform(F.array(*picks), lambda p: F.pmod(p, F.lit(words)))
    counts = F.transform(F.array(F.struct(drawn.alias("d"), first.alias("f"))), lambda s: F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda w: F.size(F.filter(s["d"], lambda d: F.pmod(d + s["f"], F.lit(words)) == w))))
    return df.select("id", "labels", counts[0].alias("counts"))


def positive_definite(source: Source, dim: int, sparse: float = 0.0) -> DataFrame:
    """(i, j, x): a symmetric matrix with a dominant diagonal; with sparse, about that share of the others is 0."""
    df = _cells(source, dim, dim).withColumn("j", F.col("j").cast("long"))
    lo, hi = F.least("i", "j"), F.greatest("i", "j")
    off = F.when(digest("zero", lo, hi) < sparse, 0.0).otherwise(2 * digest("off", lo, hi) - 1)
    return df.select("i", "j", F.when(F.col("i") == F.col("j"), F.lit(float(dim))).otherwise(off).alias("x"))


def sparse_coded(source: Source, n: int = 0, words: int = 20, dim: int = 8, nonzero: int = 3) -> DataFrame:
    """id, code (array of structs word, weight) and v: sums of few normal dictionary rows, picked by digest (one may be picked twice)."""
    at = [F.floor(digest(f"at{k}", F.col("id")) * words).cast("int") for k in range(nonzero)]
    w = [digest_normal(f"weight{k}", F.col("id")) for k in range(nonzero)]
    v = [sum((w[k] * digest_normal(f"row{d}", at[k]) for k in range(nonzero)), F.lit(0.0)) for d in range(dim)]
    return _ids(source, n).select("id", F.array(*[F.struct(a.alias("word"), x.alias("weight")) for a, x in zip(at, w, strict=True)]).alias("code"), F.array(*v).alias("v"))
