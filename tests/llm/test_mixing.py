"""Sainte-Laguë seats against one seat at a time, and integer quotas of blocks in every shard, whatever the ids."""

import hashlib
import heapq
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from showerlake.llm import mixing


def plain_seats(votes, seats):
    """Seats go one after another to the highest quotient; ties to the smaller key."""
    heap = [(-v, k, 0) for k, v in sorted(votes.items()) if v > 0]
    heapq.heapify(heap)
    won = Counter()
    for _ in range(seats if heap else 0):
        _, k, i = heapq.heappop(heap)
        won[k] += 1
        heapq.heappush(heap, (-votes[k] / (2 * (i + 1) + 1), k, i + 1))
    return won


def test_seats(spark):
    rng = np.random.default_rng(3)
    groups, rows = {}, []
    for g in range(60):
        n = int(rng.integers(1, 40))
        votes = {k: float(v) for k, v in enumerate(rng.integers(0, 30, n) if g % 3 == 0 else rng.exponential(100, n))}
        if g % 4 == 0:
            votes[0] = 20_000.0  # one that has nearly all
        seats = int(rng.integers(0, 3_000)) if g % 2 else int(rng.integers(0, n + 3))
        groups[g] = (votes, seats)
        rows += [(g, k, v, seats) for k, v in votes.items()]
    got = mixing.sainte_lague(spark.createDataFrame(rows, "g int, k int, votes double, seats long"), ["g", "k"], F.col("seats"), ["g"]).collect()
    for g, (votes, seats) in groups.items():
        assert {r["k"]: r["quota"] for r in got if r["g"] == g and r["quota"]} == dict(plain_seats(votes, seats)), g


def test_integer_blocks_in_every_shard(spark):
    """20 sources; ids step by 20, are null or are all the same; a tiny source stands beside the others."""
    rng = np.random.default_rng(1)
    rows = [(20 * i + s, f"s{s:02d}", int(n)) for s in range(17) for i, n in enumerate(rng.integers(100, 5_000, 300))]
    rows += [(None, "no id", int(n)) for n in rng.integers(100, 5_000, 300)] + [(7, "one id", int(n)) for n in rng.integers(100, 5_000, 300)] + [(-i, None, int(n)) for i, n in enumerate(rng.integers(100, 5_000, 300))]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(5)
    got = mixing.taken_words(df, rows_per_shard=20).collect()
    again = mixing.taken_words(df.repartition(3), rows_per_shard=20).collect()
    plain = lambda rs: Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in rs)
    assert plain(got) == plain(again) and len(got) == len(rows)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in got}
    shards = 15
    block = max(1, int(min(t for t, _ in targets.values()) // (mixing.LEAST_BLOCKS * shards)))
    units, taken = defaultdict(Counter), defaultdict(Counter)
    for r in got:
        key = hashlib.md5(f"{mixing.SEED}:{'null' if r['doc_id'] is None else r['doc_id']}:{r['size']}".encode()).hexdigest()
        units[r["source"]][int(key[:8], 16) % shards] += r["size"]
        taken[r["source"]][int(key[:8], 16) % shards] += r["taken"]
    blocks = round(sum(t for t, _ in targets.values()) / block)
    order = sorted(targets, key=lambda s: (s is None, s or ""))
    seats = plain_seats({i: targets[s][0] for i, s in enumerate(order)}, blocks)
    for i, s in enumerate(order):
        target, size = targets[s]
        assert len(units[s]) == shards, s  # all are filled, also by rows without an id and with one id
        assert abs(sum(taken[s].values()) - target) <= 0.002 * target
        won = plain_seats({k: float(v) for k, v in units[s].items()}, seats[i])
        for k, size in units[s].items():
            full = target >= 2 * targets[s][1] or won[k] * block > 2 * size
            assert taken[s][k] == (2 * size if full else won[k] * block), (s, k)
    assert sum(target < 2 * size for target, size in targets.values()) > 5


def test_tiny_source_beside_a_large_one(spark):
    df = spark.createDataFrame([(i, "big", 1_000_000) for i in range(3_000)] + [(5000, "small", 12), (5001, "small", 8), (5002, "none", 0)], "doc_id long, source string, size long")
    got = {r["source"]: r for r in mixing.taken_words(df, rows_per_shard=100).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert got["small"]["taken"] == got["small"]["target"] == 40 and got["none"]["taken"] == 0 and abs(got["big"]["taken"] - got["big"]["target"]) < 100
