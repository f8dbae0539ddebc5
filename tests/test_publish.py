"""Guards in the writing pass, publishing in two phases, scratch tables, digests, triage by index, ranks."""

import random

import pytest
from pyspark.sql import functions as F

from rosterspark.functions import arrays
from rosterspark.operators import digest, relational
from rosterspark.operators.relational import GuardError
from rosterspark.sources import files, publish, scratch


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (3, 9, None)], "season int, game int, v string")


def test_a_failing_guard_leaves_the_target_untouched(spark, rows, tmp_path):
    path = f"file://{tmp_path}/t"
    assert publish.read_published(spark, path) is None and publish.manifest(spark, path)["parts"] == []
    ok = [publish.rows_at_least(4), publish.share_at_least("said", F.col("v").isNotNull(), 0.7), publish.spread("games", F.col("game")), publish.none_where("negative", F.col("game") < 0)]
    found = publish.publish(rows, path, ok)
    assert found["rows"] == 4 and found["said"] == 0.75 and found["negative"] == 0
    for bad in (publish.rows_at_least(5), publish.none_where("no_v", F.col("v").isNull()), publish.share_at_least("said", F.col("v").isNotNull(), 0.8), publish.spread("one", F.lit(1.0))):
        with pytest.raises(GuardError, match=bad.name):
            publish.publish(rows, path, [bad])
        assert publish.read_published(spark, path).count() == 4 and publish.sweep(spark, path) == 0


def test_empty_lineups_warn_and_pass(spark, tmp_path):
    df = spark.createDataFrame([(["a"], ["b"]), ([], ["b"]), (None, None), (["a"], ["c"])], "home array<string>, away array<string>")
    guard = publish.few_empty("empty_lineups", [F.col("home"), F.col("away")], 0.1)
    with pytest.warns(UserWarning, match="empty_lineups: 0.5"):
        found = publish.publish(df, f"file://{tmp_path}/t", [guard])
    assert found["empty_lineups"] == 0.5 and publish.read_published(spark, f"file://{tmp_path}/t").count() == 4
    with pytest.raises(GuardError):
        publish.publish(df, f"file://{tmp_path}/t", [publish.few_empty("empty", [F.col("home")], 0.1, fatal=True)])


def test_path_values(spark, rows, tmp_path):
    path = f"file://{tmp_path}/p"
    rows.withColumn("part", F.col("season")).write.partitionBy("part").parquet(path)
    read = files.read_shards(spark, path).select("season", files.path_value("part").alias("part"), files.path_value("other").alias("other"))
    assert {tuple(r) for r in read.collect()} == {(1, "1", None), (2, "2", None), (3, "3", None)}


def test_the_input_is_read_once(spark, rows, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    once = rows.mapInPandas(count, rows.schema)
    publish.publish(once, f"file://{tmp_path}/t", [publish.rows_at_least(1), publish.none_where("x", F.col("game") < 0)])
    assert seen.value == 4


def test_the_next_run_writes_only_what_is_missing(spark, rows, tmp_path):
    path, keys = f"file://{tmp_path}/t", ["season", "game"]
    expected = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2)], "season int, game int")
    first = publish.publish_missing(rows.where("season = 1"), path, keys, expected, [publish.rows_at_least(0)])
    assert first["rows"] == 2 and publish.manifest(spark, path)["missing"] == 2 and not publish.manifest(spark, path)["complete"]
    folder = publish.Folder(spark, path)
    assert "_MISSING" in folder.names() and "_SUCCESS" not in folder.names()
    gone = spark.read.option("header", True).csv(f"{path}/{folder.read('_MISSING').strip()}")
    assert sorted(map(tuple, gone.collect())) == [("2", "1"), ("2", "2")]
    # A run that dies after its part is written leaves nothing that is read.
    rows.write.parquet(f"{path}/parts/dead")
    assert publish.read_published(spark, path).count() == 2
    more = rows.unionByName(spark.createDataFrame([(2, 2, "d")], rows.schema))
    second = publish.publish_missing(more, path, keys, expected, [publish.rows_at_least(0)])
    assert second["rows"] == 2 and publish.manifest(spark, path)["complete"]
    assert "_SUCCESS" in folder.names() and "_MISSING" not in folder.names()
    assert sorted(r["v"] for r in publish.read_published(spark, path).collect()) == ["a", "b", "c", "d"]
    assert publish.sweep(spark, path) == 1 and publish.read_published(spark, path).count() == 4


def test_two_runs_cannot_publish_one_manifest(spark, rows, tmp_path):
    path = f"file://{tmp_path}/t"
    publish.publish(rows, path)
    folder = publish.Folder(spark, path)
    with pytest.raises(GuardError, match="another run"):
        folder.create_once("manifest-000000000", "{}")
    assert len(publish.manifest(spark, path)["parts"]) == 1 and not [n for n in folder.names() if n.startswith("_draft")]
    publish.publish(rows.limit(1), path, replace=False)
    assert publish.read_published(spark, path).count() == 5
    publish.publish(rows.limit(1), path)
    assert publish.read_published(spark, path).count() == 1


def test_scratch_tables_have_an_owner(spark, rows):
    scratch.clear(spark)
    kept = scratch.materialise(rows, "x")
    assert kept.count() == 4
    jvm = spark.sparkContext._jvm
    other = jvm.org.apache.hadoop.fs.Path(f"{scratch.shared_dir(spark)}/{scratch.PREFIX}other")
    files = other.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(other)
    assert scratch.clear_others(spark, hours=1) == 0 and scratch.clear_others(spark, hours=-1) == 1
    assert not files.exists(other) and kept.count() == 4
    assert scratch.clear(spark) == 1 and scratch.clear(spark) == 0


def test_digests_find_every_difference(spark):
    a = spark.range(4000).select(F.col("id"), (F.col("id") % 7).cast("int").alias("k"), F.when(F.col("id") % 5 > 0, "x").alias("s"))
    assert digest.same(a, a.repartition(7).select("s", "id", "k")) and not digest.same(a, a.drop("s"))
    b = a.where("id <> 17").unionByName(a.where("id IN (3, 3000)")).withColumn("s", F.when(F.col("id") == 99, "y").otherwise(F.col("s")))
    for chunks in (2, 4096):
        assert not digest.same(a, b, chunks)
        found = sorted(map(tuple, digest.differing_rows(a, b, chunks).collect()), key=repr)
        assert found == sorted([(17, 3, "x", 1, 0), (3, 3, "x", 1, 2), (3000, 4, None, 1, 2), (99, 1, "x", 1, 0), (99, 1, "y", 0, 1)], key=repr)
    nulls = spark.createDataFrame([(None, 1), (1, None)], "a int, b int")
    turned = spark.createDataFrame([(1, None), (1, None)], "a int, b int")
    assert digest.differing_rows(nulls, turned).count() == 2 and digest.differing_rows(nulls, nulls).count() == 0
    assert digest.differing_rows(a.limit(0), a.limit(0)).count() == 0


def test_triage_of_many_ids_under_one_name(spark):
    many = spark.range(100_000).select(F.lit("hot").alias("name"), F.col("id").cast("string").alias("id"), F.col("id").cast("string").alias("id_norm"), F.array(F.col("id")).alias("seasons"), F.array(F.lit(1), F.col("id")).alias("teams"), F.col("id").alias("n_rows"))
    rest = [("form", "1", "1", [1], [1], 5), ("form", "01", "1", [1], [1], 7), ("apart", "a", "a", [1, 1], [1], 2), ("apart", "b", "b", [2], [1], 2), ("team", "a", "a", [1, 2], [5], 1), ("team", "b", "b", [2], [5, 6], 1), ("two", "a", "a", [2], [5], 1), ("two", "b", "b", [2], [6], 1), ("none", "a", "a", None, None, 1), ("none", "b", "b", [None], [], 1), ("one", "a", "a", [1], [1], 1)]
    ids = many.unionByName(spark.createDataFrame(rest, "name string, id string, id_norm string, seasons array<bigint>, teams array<bigint>, n_rows long"))
    found = {r["name"]: (r["n_ids"], r["verdict"]) for r in relational.triage_collisions(ids).collect()}
    assert found == {"hot": (100_000, "MERGE_DISJOINT"), "form": (2, "MERGE_FORMAT"), "apart": (2, "MERGE_DISJOINT"), "team": (2, "REVIEW_OVERLAP_SAMETEAM"), "two": (2, "KEEP_SEPARATE_HOMONYM"), "none": (2, "MERGE_DISJOINT")}
    merges = relational.merge_proposal(ids, relational.triage_collisions(ids))
    assert merges.where("name = 'hot'").count() == 99_999 and merges.where("name = 'hot' AND to_id <> '99999'").count() == 0
    assert {tuple(r) for r in merges.where("name <> 'hot' AND name <> 'none'").collect()} == {("form", "1", "01"), ("apart", "b", "a")}


def test_entries_that_many_ids_share(spark):
    hot = spark.range(100_000).select(F.lit("hot").alias("name"), F.col("id").cast("string").alias("id"), F.array(F.lit(7).cast("bigint"), F.col("id") + 100).alias("seasons"), F.array(F.lit("x")).alias("teams"))
    rng, few = random.Random(5), []
    for k in range(60):
        few.append((rng.choice(["a", "b", None]), str(k), rng.choice([None, [], [None], [rng.randrange(6), rng.randrange(6)]]), [f"t{rng.randrange(9)}"] * 2))
    small = spark.createDataFrame(few, "name string, id string, seasons array<bigint>, teams array<string>")
    found = arrays.shared_entries(hot.unionByName(small).unionByName(small.limit(5)), "name", "id", ["seasons", "teams"])
    assert found.where("name = 'hot'").groupBy("kind", "entry", "n_ids", "first_id").count().orderBy("kind").collect() == [("seasons", "7", 100_000, "0", 100_000), ("teams", "x", 100_000, "0", 100_000)]
    holders = {}
    for name, ident, seasons, teams in few:
        for kind, own in (("seasons", seasons), ("teams", teams)):
            for e in own or []:
                if e is not None:
                    holders.setdefault((name, kind, str(e)), set()).add(ident)
    want = {(*k, i, len(own), min(own)) for k, own in holders.items() if len(own) > 1 for i in own}
    rows = found.where("NOT name <=> 'hot'").select("name", "kind", "entry", "id", "n_ids", "first_id").collect()
    assert set(map(tuple, rows)) == want and len(rows) == len(want)


def test_ranks_without_one_task(spark):
    rng = random.Random(3)
    values = [(i, rng.choice([None, 1.0, 2.5, float(rng.randrange(50))])) for i in range(2000)]
    df = spark.createDataFrame(values, "id int, v double").repartition(6)
    found = {r["id"]: r["rank"] for r in relational.ranked(df, [F.desc("v"), F.asc("id")]).collect()}
    want = sorted(values, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    assert found == {i: k for k, (i, _) in enumerate(want, 1)}
