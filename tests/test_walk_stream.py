"""Stints and possessions of a file stream, as the batch operators give them; also after a restart."""

import random

from pyspark.sql import functions as F

from rosterspark.operators import sequence
from rosterspark.streaming import walk

CODES = sequence.Codes(("MADE",), ("TO",), ("D",), ("FTM",), ("FTM", "FTA"), ("EP",), ("EP", "NEUTRAL"))
SCHEMA = "game string, n long, ts timestamp, team string, home string, away string, code string, key string"


def test_a_stream_gives_the_batch_rows(spark, tmp_path):
    rng = random.Random(12)
    rows = []
    for g in ("g1", "g2", "g3"):
        key = "x"
        for n in range(1, 61):
            key = rng.choice([key, key, key, "x", "y", None])
            code = rng.choice(["MADE", "TO", "D", "FTM", "FTM", "FTA", "EP", "NEUTRAL"])
            rows.append((g, n, 60 * n, rng.choice(["A", "B"]) if code != "NEUTRAL" else None, "A", "B", code, key))
    log = spark.createDataFrame(rows, "game string, n long, s long, team string, home string, away string, code string, key string")
    log = log.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s"))).select(*[c.split()[0] for c in SCHEMA.split(", ")])
    source, target, state = (f"file://{tmp_path}/{k}" for k in ("in", "out", "state"))

    def arrive(part):  # in one file, in any order
        part.orderBy(F.rand(3)).coalesce(1).write.mode("append").parquet(source)

    def run():
        events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        out = walk.walk_stream(events, "game", "ts", CODES, "5 minutes", 600_000)
        out.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    arrive(log.where("n <= 25 AND n <> 24"))
    arrive(log.where("n = 24 OR n BETWEEN 26 AND 40"))  # 24 comes after 25, but in time
    run()
    first = spark.read.parquet(target).count()
    assert 0 < first < 3 * 40
    arrive(log.where("n > 40"))
    arrive(log.where("game = 'g1' AND n = 2").withColumn("code", F.lit("EP")))  # long past
    clock = log.limit(1).select(F.lit("clock").alias("game"), F.lit(1).cast("long").alias("n"), (F.col("ts") + F.expr("INTERVAL 9 DAYS")).alias("ts"), "team", "home", "away", F.lit("NEUTRAL").alias("code"), "key")
    arrive(clock)
    run()
    found = spark.read.parquet(target).where("game <> 'clock'")
    on_time = found.where("NOT late")
    one = sequence.Log()
    batch = sequence.segment_ids(log, [F.col("key")], one).withColumn("trip_end", sequence.trip_end(CODES, one))
    batch = sequence.possession_ends(batch, (F.col("home"), F.col("away")), CODES, one)
    columns = ["game", "n", "stint_id", "trip_end", "ends", "credited"]
    want = sorted((r["game"], r["n"], r["stint_id"], r["trip_end"], r["ends"], r["credited"]) for r in batch.select(*columns).collect())
    assert sorted((tuple(r) for r in on_time.select(*columns).collect()), key=repr) == sorted(want, key=repr)


def test_late_rows_and_closed_games():
    game = walk.fresh()
    row = lambda n, code, key="k": {"n": n, "ts": 10 * n, "team": "A", "home": "A", "away": "B", "code": code, "key": key}
    game["held"] = [row(2, "FTM"), row(1, "MADE")]
    assert walk.moved(game, 10, False, CODES) == []  # the first waits for the next
    out = walk.moved(game, 20, True, CODES)
    assert [(r["n"], r["stint_id"], r["trip_end"], r["credited"]) for r in out] == [(1, 0, False, "A"), (2, 0, True, "A")]
    game["held"] = [row(1, "TO"), row(3, "EP", "other")]
    out = walk.moved(game, 99, True, CODES)
    assert [(r["n"], r["stint_id"], r["late"], r["credited"]) for r in out] == [(1, None, True, None), (3, 1, False, "B")]
