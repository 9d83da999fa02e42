"""Values on edges, and quantiles between equal neighbours."""

from pyspark.sql import functions as F

from showerlake.functions import quantiles as qs
from showerlake.operators import panels as pn


def test_a_quantile_between_equal_values_is_that_value(spark):
    df = spark.range(4 * 997).select((F.col("id") % 4).alias("k"), F.element_at(F.array(F.lit(-0.1), F.lit(0.07), F.lit(1 / 3), F.lit(-1e-9)), (F.col("id") % 4 + 1).cast("int")).alias("v"))
    probs = [i / 97 for i in range(1, 97)]
    for r in qs.quantiles(df, ["k"], {"q": (F.col("v"), probs)}, small=0).collect():
        assert set(r["q"]) == {[-0.1, 0.07, 1 / 3, -1e-9][r["k"]]}


def test_hist2d_puts_values_on_an_edge_into_the_upper_bin(spark):
    df = spark.createDataFrame([(0.5, 0.15), (0.5, 0.1 + 0.05), (0.5, 0.1 + 0.2), (0.5, 0.3), (0.5, 0.35), (1.0, 0.149)], "p double, e double")
    got = {(r["bx"], r["by"]): r["n"] for r in pn.hist2d(df, ("p", 0.0, 1.0), ("e", 0.0, 0.05)).collect()}
    assert got == {(0, 3): 2, (0, 6): 2, (0, 7): 1, (1, 2): 1}
