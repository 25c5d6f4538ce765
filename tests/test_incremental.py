"""Incremental load replayed and in any order, and state within its bounds."""

import random

from pyspark.sql import functions as F

from graphloom.plans.ontology import document_stream, graph_load
from graphloom.streaming import expiry, incremental, live

DATA = "/root/testdata/sf0.001"


def files(spark, df, folder, parts):
    """One Parquet file for each part, so that a stream takes them one by one."""
    folder.mkdir()
    for k, part in enumerate(parts):
        df.where(part).coalesce(1).write.parquet(str(folder.parent / f"{folder.name}-{k}"))
        (name,) = (folder.parent / f"{folder.name}-{k}").glob("*.parquet")
        name.rename(folder / f"part{k}.parquet")
    return str(folder)


def test_load_is_the_same_however_it_comes(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source")
    docs = docs.unionByName(docs.limit(30).withColumn("doc_id", F.col("doc_id") + 1000)).unionByName(spark.createDataFrame([(None, None, "en", "a"), (5000, "", None, None)], docs.schema))
    whole = files(spark, docs, tmp_path / "whole", ["true"])
    mixed = files(spark, docs, tmp_path / "mixed", [f"pmod(xxhash64(doc_id), 5) = {k}" for k in (3, 0, 4, 1, 2)])
    one = graph_load(spark, "file://" + str(tmp_path / "one"))
    one.run(document_stream(spark, whole, "*.parquet"))
    want = sorted(map(tuple, one.graph().collect()))
    assert len(want) > 100 and one.counters().agg(F.sum("mentions")).first()[0] == docs.count()

    # a load that is killed in its third batch, between its two writes, and started anew
    load = graph_load(spark, "file://" + str(tmp_path / "some"))
    merge, calls = load.merge, []

    def dies(batch, number):
        calls.append(number)
        if number == 2 and calls.count(2) == 1:
            triples, load.triples = load.triples, lambda df: 1 / 0
            try:
                merge(batch, number)
            finally:
                load.triples = triples
        merge(batch, number)

    load.merge = dies
    stream = lambda: document_stream(spark, mixed, "*.parquet", per_trigger=1)
    try:
        load.run(stream())
    except Exception as e:  # the query's error wraps it
        assert "ZeroDivision" in str(e) or "division" in str(e)
    else:
        raise AssertionError("the second batch should have failed")
    assert sorted(map(tuple, load.graph().collect())) != want
    load.run(stream())
    assert calls == [0, 1, 2, 2, 3, 4] and sorted(map(tuple, load.graph().collect())) == want
    # a batch run once more changes nothing, nor does a run without new files
    load.run(stream())
    merge(spark.read.parquet(f"{mixed}/part2.parquet").select(F.concat_ws("/", "source", "lang").alias("head"), F.col("doc_id").alias("seq"), "text").limit(0), 9)
    assert calls == [0, 1, 2, 2, 3, 4] and sorted(map(tuple, load.graph().collect())) == want


def test_windows(spark):
    assert [incremental.window_seconds(x) for x in ("90m", "12h", " 1D ", "2w", "3")] == [5400, 43200, 86400, 1209600, 259200]
    rows = spark.createDataFrame([("2024-01-10 00:00:00",), ("2024-01-08 23:59:59",), ("2024-01-09 00:00:01",), (None,)], "at string")
    got = incremental.recent(rows, "at", "1d", F.lit("2024-01-10 00:00:00"))
    assert sorted(r["at"] for r in got.collect()) == ["2024-01-09 00:00:01", "2024-01-10 00:00:00"]


def test_known_keys_are_bounded(spark, tmp_path):
    """A key is told again once enough others have come after it, as a replay in order does; no more are kept."""
    rng = random.Random(3)
    keys = [f"k{int(rng.paretovariate(0.5)) % 90}" for _ in range(600)]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)] + [(None, 7)], "name string, i long")
    folder = files(spark, df, tmp_path / "in", [f"i div 150 = {k}" for k in range(4)])
    stream = spark.readStream.schema("name string, i long").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)
    got = live.run_once(expiry.first_seen(stream, "name", "i", shards=1, most=20, kept=10), "file://" + str(tmp_path / "out"), "append")
    known, want = [], []
    for i, k in enumerate(keys):
        if k not in known:
            want.append((k, i))
            known.append(k)
            if len(known) > 20:
                known = known[-10:]
            assert len(known) <= 20
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > len(set(keys))


def test_cache_expires(spark, tmp_path):
    rng = random.Random(5)
    rows = sorted((rng.randrange(20 * 86400), f"u{rng.randrange(6)}", 500 if rng.random() < 0.2 else 200) for _ in range(200))
    df = spark.createDataFrame([(u, i, t, s) for i, (t, u, s) in enumerate(rows)], "url string, i long, t long, status int").withColumn("at", F.timestamp_seconds("t"))
    folder = files(spark, df, tmp_path / "in", [f"t div (5 * 86400) = {k}" for k in range(4)])
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = live.run_once(expiry.cached(stream, "url", "at", "i", "status", late="0 seconds"), "file://" + str(tmp_path / "out"), "append")
    at, want = {}, set()
    for i, (t, u, s) in enumerate(rows):
        hit = u in at and t < at[u] + 86400
        if not hit and s == 200:
            at[u] = t
        want.add((u, i, hit))
    assert {tuple(r) for r in got.collect()} == want
