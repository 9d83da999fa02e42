"""Model analysis: splits, boosted fits of all outputs and folds, and metrics over a table of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import estimates as es
from ..sources.shared import written
from . import boosting

OUTPUTS = ("p", "theta", "phi")
FEATURES = ("width", "height", "depth", "mean_r", "max_r", "weighted_r", "n", "e")


def fold(seed: int = 0, folds: int = 5):
    """Fold of an event from its number and a seed, by arithmetic that any engine has."""
    return F.pmod(F.col("event_number") * 7919 + seed * 104729, F.lit(1000003)) % folds


def split(df: DataFrame, seed: int = 0) -> DataFrame:
    return df.withColumn("holdout", (fold(seed) == 0).cast("int"))


def assembled(df: DataFrame, names=FEATURES) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(names), outputCol="features").transform(df.fillna(0.0, list(names)))


def fit_outputs(df: DataFrame, outputs: tuple[str, ...] = OUTPUTS, folds: tuple[int, ...] = (0, 1, 2, 3, 4), trees: int = 100, rate: float = 0.1, depth: int = 3) -> boosting.Boosted:
    """One model for each output and fold (the fold is held out), all grown in step."""
    return boosting.fit(df, fold(), FEATURES, outputs, folds, trees, rate, depth)


def predict_outputs(model: boosting.Boosted, df: DataFrame) -> DataFrame:
    """The rows of the model's folds, with the fold and pred_<output> by the models that have not seen them."""
    return boosting.predicted(model, df, fold())


def surrogate(df: DataFrame, target: str = "pred", depth: int = 3) -> DataFrame:
    """A shallow tree on predictions: rows, mean and variance of each leaf, by the values that the tree gives, and the tree's
    R2 and mean absolute error over all rows."""
    from pyspark.ml.regression import DecisionTreeRegressor

    # Written once: the tree reads its rows again and again, and each time they would be predicted anew.
    rows = assembled(written(df.select(target, *FEATURES), "surrogate"))
    leaf = DecisionTreeRegressor(labelCol=target, maxDepth=depth, predictionCol="leaf", seed=7).fit(rows).transform(rows)
    leaf = leaf.withColumn("_off", F.abs(F.col(target) - F.col("leaf")))
    whole = leaf.agg((1 - F.avg(F.col("_off") ** 2) / F.var_pop(target)).alias("r2"), F.avg("_off").alias("mae"))
    return leaf.groupBy("leaf").agg(F.count("*").alias("n"), F.avg(target).alias("value"), F.var_samp(target).alias("variance")).crossJoin(F.broadcast(whole))


def split_check(preds: DataFrame, seeds: int = 100) -> DataFrame:
    """Mean squared error of both parts for many splits. A split depends on an event's residue alone, so rows are summed by
    residue first (about a million at most, whatever the rows), and only those sums are taken once for each seed."""
    sq = (F.col("pred") - F.col("p")) ** 2
    by = preds.groupBy(F.pmod(F.col("event_number") * 7919, F.lit(1000003)).alias("at")).agg(F.count("*").alias("n"), F.count(sq).alias("k"), F.sum(sq).alias("sq"))
    each = by.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    held = F.pmod(F.col("at") + F.col("seed") * 104729, F.lit(1000003)) % 5 == 0
    mean = lambda rule: F.try_divide(F.sum(F.when(rule, F.col("sq"))), F.sum(F.when(rule, F.col("k"))))
    return each.groupBy("seed").agg(mean(held).alias("mse_valid"), mean(~held).alias("mse_train"), F.coalesce(F.sum(F.when(held, F.col("n"))), F.lit(0)).alias("n_valid"))


def fold_metrics(preds: DataFrame, pred: str = "pred", truth: str = "p", wrapped: bool = False) -> DataFrame:
    """Errors of each fold; those of an azimuth are wrapped, and it has no R2."""
    err = F.col(pred) - F.col(truth)
    err = F.atan2(F.sin(err), F.cos(err)) if wrapped else err
    by = preds.groupBy(fold().alias("fold")).agg(F.count("*").alias("n"), F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"), F.var_pop(truth).alias("v"))
    return by.withColumns({"rmse": F.sqrt("mse"), "r2": F.lit(None).cast("double") if wrapped else 1 - F.col("mse") / F.col("v")})


def mean_interval(folds: DataFrame, col: str = "mae") -> DataFrame:
    """Mean over folds with Nadeau and Bengio's corrected t-interval: variance times (1/k + test/train)."""
    by = folds.agg(F.count("*").alias("k"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("s"))
    half = es.t975(F.col("k") - 1) * F.col("s") * F.sqrt(1 / F.col("k") + 1 / (F.col("k") - 1))
    return by.withColumns({"lo": F.col("mean") - half, "hi": F.col("mean") + half})


def output_order(preds: DataFrame, outputs: list[str], labels: list[str]) -> DataFrame:
    """Squared error of every output against every label: each must be best at its own."""
    rows = F.array(*[F.struct(F.lit(o).alias("output"), F.lit(t).alias("label"), ((F.col(o) - F.col(t)) ** 2).alias("sq")) for o in outputs for t in labels])
    return preds.select(F.inline(rows)).groupBy("output", "label").agg(F.avg("sq").alias("mse"))


def binary_sample(preds: DataFrame, low: int = 1980, high: int = 20, least: float = 2.0, far: float = 10.0, enough: int = 50) -> DataFrame:
    """99 : 1 of the two momentum pools among the held-out rows: the first of each in hashed order. The pool above `far`
    gives way to all above `least` where it has under `enough` rows; `fallback` says so."""
    held = split(preds).filter("holdout = 1").drop("holdout")
    few = held.agg((F.count_if(F.col("p") > far) < enough).alias("few"))
    rows = held.crossJoin(F.broadcast(few)).withColumn("fallback", F.col("few").cast("int")).drop("few")
    key = F.pmod(F.col("event_number") * 7919, F.lit(1000003))
    pool = lambda rule, n, y: rows.filter(rule).withColumn("y", F.lit(y)).orderBy(key, "event_number").limit(n)
    upper = F.col("p") > F.when(F.col("fallback") == 1, least).otherwise(far)
    return pool(F.col("p") < least, low, 0).unionByName(pool(upper, high, 1))


def confusion(df: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Counts and rates of p > threshold, with Wilson intervals; balanced accuracy has the one that combines the limits of
    both classes' recalls (MOVER)."""
    t, p = F.col("p") > threshold, F.col("pred") > threshold
    by = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"), F.count("*").alias("n"))
    c = F.col
    rates = {"accuracy": (c("tp") + c("tn"), c("n")), "recall": (c("tp"), c("tp") + c("fn")), "recall_0": (c("tn"), c("tn") + c("fp")), "precision": (c("tp"), c("tp") + c("fp")), "precision_0": (c("tn"), c("tn") + c("fn"))}
    for name, (k, n) in rates.items():
        lo, hi = es.wilson(k, F.nullif(n, F.lit(0)))
        by = by.withColumns({name: F.try_divide(k, n), f"{name}_lo": lo, f"{name}_hi": hi})
    half = lambda end: F.hypot(c("recall") - c(f"recall_{end}"), c("recall_0") - c(f"recall_0_{end}")) / 2
    by = by.withColumn("balanced", (c("recall") + c("recall_0")) / 2)
    known = c("balanced").isNotNull()
    return by.withColumns({"balanced_lo": F.when(known, F.greatest(F.lit(0.0), c("balanced") - half("lo"))), "balanced_hi": F.when(known, F.least(F.lit(1.0), c("balanced") + half("hi")))})


def circ_fidelity(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """1 - sum(1 - cos of the error) over the same about the mean direction, and the mean absolute wrapped error."""
    m = df.agg(F.atan2(F.avg(F.sin(truth)), F.avg(F.cos(truth))).alias("m"))
    e = F.col(pred) - F.col(truth)
    out = df.crossJoin(F.broadcast(m)).agg(F.sum(1 - F.cos(e)).alias("rest"), F.sum(1 - F.cos(F.col(truth) - F.col("m"))).alias("all"), F.avg(F.abs(F.atan2(F.sin(e), F.cos(e)))).alias("mae"))
    return out.withColumn("fidelity", 1 - F.col("rest") / F.col("all"))


def stamp(df: DataFrame) -> DataFrame:
    """Whether a table has changed: rows and an order-free sum of 32-bit hashes of all of a row's values as text."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in sorted(df.columns)]
    row = F.conv(F.substring(F.md5(F.concat_ws("|", *values).cast("binary")), 1, 8), 16, 10).cast("long")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(row), F.lit(0)).alias("hash"))


FANOUT_BITS = 10


def _texts(columns: list[str]):
    """A row's values as one text, each with its length before it, so that no two rows of different values share it."""
    value = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.concat(*[value(c) for c in columns])


def stamp_tree(df: DataFrame, key: str, levels: int) -> DataFrame:
    """Digests of the rows by ranges of 2^(10 * levels) integer keys, each over the digests of its parts in ascending order
    of key: a row that is moved, changed or lost changes its range, and those above it.

    A leaf is one key: its rows have no order, so their SHA-256 are added in four parts of 60 bits. A range holds 1,024 parts
    at most, whatever the keys, so no task gathers more. A null key is a range of its own, the first. Columns are taken in
    the order of their names. No rows: no ranges."""
    columns = sorted(c for c in df.columns if c != key)
    hashed = df.select(F.col(key).cast("long").alias("at"), F.sha2(_texts([key, *columns]), 256).alias("h"))
    part = lambda i: F.sum(F.conv(F.substring("h", 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    level = hashed.groupBy("at").agg(F.count("*").alias("rows"), F.concat_ws(",", *[part(i) for i in range(4)]).alias("digest"))
    for _ in range(levels):
        parts = F.sort_array(F.collect_list(F.struct("at", "rows", "digest")))
        text = F.concat_ws(";", F.transform(parts, lambda p: F.concat_ws("|", F.coalesce(p["at"].cast("string"), F.lit("-")), p["rows"].cast("string"), p["digest"])))
        level = level.groupBy(F.shiftright("at", FANOUT_BITS).alias("to")).agg(F.sum("rows").alias("rows"), F.sha2(text, 256).alias("digest")).withColumnRenamed("to", "at")
    return level


def ordered_stamp(df: DataFrame, key: str) -> DataFrame:
    """Whether a table has changed: rows, and one digest over all ranges of keys in ascending order (at most 17 at the top)."""
    parts = F.sort_array(F.collect_list(F.struct("at", "digest")))
    text = F.concat_ws(";", F.transform(parts, lambda p: F.concat_ws("|", F.coalesce(p["at"].cast("string"), F.lit("-")), p["digest"])))
    return stamp_tree(df, key, 6).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.sha2(text, 256).alias("digest"))


def changed_ranges(old: DataFrame, new: DataFrame, key: str, levels: int = 1) -> DataFrame:
    """The ranges of keys (lo to hi) in which two tables differ, with the rows that each has there. Ranges that agree are
    settled by their digests alone."""
    a, b = stamp_tree(old, key, levels), stamp_tree(new, key, levels)
    both = a.select(F.col("at"), F.col("rows").alias("n_old"), F.col("digest").alias("was")).join(b.select(F.col("at").alias("to"), F.col("rows").alias("n_new"), F.col("digest").alias("is")), F.col("at").eqNullSafe(F.col("to")), "full")
    at, span = F.coalesce("at", "to"), 1 << (FANOUT_BITS * levels)
    return both.filter(~F.col("was").eqNullSafe(F.col("is"))).select((at * span).alias("lo"), (at * span + span - 1).alias("hi"), F.coalesce("n_old", F.lit(0)).alias("n_old"), F.coalesce("n_new", F.lit(0)).alias("n_new"))


def arithmetic_stamp(df: DataFrame, key: str, value: str) -> DataFrame:
    """A stamp of a key and an integer value that any engine can repeat."""
    return df.agg(F.count("*").alias("n"), F.sum(F.pmod(F.col(key) * 7919 + F.col(value) * 104729, F.lit(1000003))).alias("sum"))


