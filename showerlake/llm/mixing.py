"""Mixing sources to target weights: equal-token blocks, apportioned by the highest Sainte-Laguë quotients.

Everything is DataFrame operations. A source is cut into shards of a bounded number
of documents, by a hash of id and size, so a source with a third of all rows is many window groups, whatever its ids.
Blocks are whole words, and as many as the data need: every shard of every source has LEAST_BLOCKS of them and more,
unless that would make a block less than a word.

Sizes: words of the text; a null text has none. Sources are taken by code point, null
last, with the weights in turn. Repeated rows (also of one doc_id) each count and are
each taken for themselves; equal rows are interchangeable, so their order changes no
result. No documents, or none with words: every target and every `taken` is 0.
Other columns of the input pass through `mix_documents` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_CLASS, settled, text_column, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_REPEATS = 2
ROWS_PER_SHARD = 8_192
#: Blocks that the target of a source holds for each of its shards, at least (if they have that many words).
LEAST_BLOCKS = 256
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_CLASS + "+")).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """One row per source: its size, rows and target words.

    Filling sources up to their limits and resharing the excess by weight ends where every
    source gets min(limit, level * weight); the level follows from sources in the order in
    which they reach their limits, so no loop is needed. There are as many rows as sources."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    turn = F.row_number().over(Window.orderBy(F.col("source").cast("binary").asc_nulls_last())) - 1
    each = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    reached = Window.orderBy("reach", F.col("source").cast("binary").asc_nulls_last())
    before, after = reached.rowsBetween(Window.unboundedPreceding, -1), reached.rowsBetween(0, Window.unboundedFollowing)
    each = each.withColumn("limit", F.col("source_size") * float(most)).withColumn("reach", F.col("limit") / F.col("weight"))
    each = each.withColumn("total", F.sum("source_size").over(everything) * float(share))
    level = (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    each = each.withColumn("level_here", level)
    each = each.withColumn("level", F.max(F.when(F.col("level_here") <= F.col("reach"), F.col("level_here"))).over(everything))
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))))
    return each.select("source", "source_size", "source_rows", "total", target.alias("target"))


def sainte_lague(votes: DataFrame, keys: list[str], seats: Column, group: list[str], vote: str = "votes") -> DataFrame:
    """Seats of each row of `votes`, by the highest quotients votes / (2 k + 1) within each `group`. Ties go to the smaller keys.

    The quotients that could decide are few, however many seats there are: among n rows the last seat's quotient is within
    n / (2 seats) of votes over seats, so a row of share p wins its fair number of seats, give or take p n / 2 + 1.
    Seats below that are its own; those around it stand for election, some six quotients a row."""
    whole = Window.partitionBy(*group)
    base = votes.filter(F.col(vote) > 0).withColumns({"_seats": seats.cast("long"), "_part": F.col(vote) / F.sum(vote).over(whole), "_n": F.count("*").over(whole)})
    fair, reach = F.floor(F.col("_seats") * F.col("_part")), F.ceil(F.col("_part") * F.col("_n") / 2) + 2
    base = base.withColumns({"_own": F.greatest(F.lit(0), fair - reach), "_top": fair + reach})
    base = base.withColumn("_left", F.col("_seats") - F.sum("_own").over(whole))
    standing = base.select(*keys, "_left", F.explode(F.sequence("_own", "_top")).alias("_k"), vote)
    quotient = (F.col(vote) / (2 * F.col("_k") + 1)).alias("_q")
    order = Window.partitionBy(*group).orderBy(F.col("_q").desc(), *[F.col(k).asc_nulls_last() for k in keys])
    elected = standing.withColumn("_q", quotient).withColumn("_place", F.row_number().over(order)).filter("_place <= _left").groupBy(*keys).agg(F.count("*").alias("_won"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_e_{k}"))
    elected = elected.withColumnsRenamed({k: f"_e_{k}" for k in keys})
    return base.join(elected, on, "left").select(*keys, (F.col("_own") + F.coalesce("_won", F.lit(0))).alias("quota"))


def taken_words(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS, least_blocks: int = LEAST_BLOCKS, rows_per_shard: int = ROWS_PER_SHARD, seed: str = SEED) -> DataFrame:
    """`docs` with size, source_size, target and taken (words, repeats counted). Needs doc_id, source and size.

    The target total is cut into equal blocks of whole words, small enough that the target of each source is `least_blocks`
    and more for each of its shards. Sources get blocks by their targets, then the shards of a source get its blocks by their
    sizes: integer quotas. A shard takes its quota of blocks, or all that it may give if that is less; a source whose target
    is all that it may give is taken so in every shard. In a shard the documents stand in a seeded order, and its blocks are cut from that
    order; it is taken as often as the quota covers it, and then up to the block where the quota ends (one
    document a shard may be cut there)."""
    everything = Window.partitionBy()
    sources = source_targets(docs, weights, share, most)
    sources = sources.withColumn("_shards", F.greatest(F.lit(1), F.ceil(F.col("source_rows") / rows_per_shard)).cast("long"))
    finest = F.min(F.when(F.col("target") > 0, F.floor(F.col("target") / (least_blocks * F.col("_shards"))))).over(everything)
    sources = sources.withColumn("_block", F.greatest(F.lit(1), F.coalesce(finest, F.lit(1))).cast("long"))
    sources = sources.withColumn("_blocks", F.round(F.sum("target").over(everything) / F.col("_block")).cast("long"))
    quotas = sainte_lague(sources, ["source"], F.col("_blocks"), [], "target")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string")).cast("binary"))
    placed = docs.join(sources.withColumnRenamed("source", "_source"), docs["source"].eqNullSafe(F.col("_source"))).drop("_source").withColumn("_key", key)
    placed = placed.withColumn("_shard", F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") % F.col("_shards"))
    units = placed.groupBy("source", "_shard").agg(F.sum("size").alias("unit_size"))
    about = sources.select(F.col("source").alias("_s"), "_block", (F.col("target") >= F.col("source_size") * float(most)).alias("_full"))
    about = about.join(quotas.withColumnsRenamed({"source": "_q", "quota": "source_quota"}), F.col("_s").eqNullSafe(F.col("_q")), "left").drop("_q")
    units = units.join(about, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    own = sainte_lague(units, ["source", "_shard"], F.coalesce("source_quota", F.lit(0)), ["source"], "unit_size").withColumnsRenamed({"source": "_s", "_shard": "_sh"})
    units = units.join(own, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_sh")), "left").drop("_s", "_sh")
    limit = most * F.col("unit_size")
    units = units.withColumn("_words", F.when(F.col("_full"), limit).otherwise(F.least(F.coalesce("quota", F.lit(0)) * F.col("_block"), limit)).cast("long"))
    units = units.select(F.col("source").alias("_us"), F.col("_shard").alias("_ush"), "unit_size", "_words")
    out = placed.join(units, F.col("source").eqNullSafe(F.col("_us")) & (F.col("_shard") == F.col("_ush"))).drop("_us", "_ush")
    seeded = Window.partitionBy("source", "_shard").orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("_start", F.sum("size").over(seeded) - F.col("size"))
    times = F.when(F.col("unit_size") > 0, F.floor(F.col("_words") / F.col("unit_size"))).otherwise(0).cast("long")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_words") - times * F.col("unit_size") - F.col("_start")))
    out = out.withColumn("taken", (times * F.col("size") + rest).cast("long"))
    return out.drop("source_rows", "total", "_block", "_blocks", "_shards", "_shard", "_key", "_start", "_words", "unit_size")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mixed rows of `docs`, in its columns: a document once for each whole time it is taken, and once more cut
    after its first words where the last block of its shard ends in it.

    Only ids and sizes go through the apportionment, which ends in a table of shares; the texts move once, to meet
    their share. Rows that are equal in every column move as one row with the list of their shares."""
    row = F.xxhash64(*[F.col(c) for c in docs.columns]).alias("_row")
    key = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")).alias("_id")  # no null, so that both sides are dealt by it

    def shared_out() -> DataFrame:
        slim = written(docs.select("doc_id", "source", word_count(text_column()).alias("size"), row), "sizes")
        return taken_words(slim, **how).filter("taken > 0").groupBy("_row", key).agg(F.first("size").alias("_size"), F.collect_list("taken").alias("_taken"))

    shares = settled(docs.sparkSession, "shares", shared_out)
    own = [c for c in docs.columns if c not in ("doc_id", "text")]
    named = docs.select(F.col("doc_id"), text_column().alias("_text"), *[F.col(c).alias(f"_own_{i}") for i, c in enumerate(own)], row, key)
    rows = named.groupBy("_row", "_id").agg(F.first("doc_id").alias("doc_id"), F.first("_text").alias("_text"), *[F.first(f"_own_{i}").alias(f"_own_{i}") for i in range(len(own))])
    met = rows.join(shares, ["_row", "_id"]).drop("_id", "_row").withColumn("_t", F.explode("_taken")).drop("_taken")
    pieces = F.split("_text", f"(?<={WORD_CLASS})(?={SPACE_CLASS})")
    part = F.col("_t") % F.col("_size")
    head = F.concat_ws("", F.slice(pieces, F.lit(1), part.cast("int")))
    whole = F.array_repeat("_text", F.floor(F.col("_t") / F.col("_size")).cast("int"))
    copies = F.concat(whole, F.when(part > 0, F.array(head)).otherwise(F.array().cast("array<string>")))
    mixed = met.withColumn("_copy", F.explode(copies))
    new = {"text": F.col("_copy"), "doc_id": F.col("doc_id")} | {c: F.col(f"_own_{i}") for i, c in enumerate(own)}
    if "n_chars" in own:
        new["n_chars"] = F.length("_copy").cast(docs.schema["n_chars"].dataType)
    return mixed.select(*[new[c].alias(c) for c in docs.columns])
