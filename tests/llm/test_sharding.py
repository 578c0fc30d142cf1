import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from kalibra.llm import sharding

SCHEMA = "doc_id long, text string, source string, shard string, position long"


def test_shards_are_even_gapless_and_mixed(spark):
    rows = [(i, f"text {i % 7}" if i % 11 else None, "big" if i % 3 else f"s{i % 5}", "x", 1) for i in range(1000)]
    rows += [(7, "text 0", "big", "x", 1)] * 3 + [(None, "", None, None, None)]
    got = sharding.assign(spark.createDataFrame(rows, SCHEMA), 8).collect()
    assert len(got) == len(rows)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    share = Counter(r[2] for r in rows)
    for source, n in share.items():
        each = Counter(r.shard for r in got if r.stratum == source)
        assert all(abs(each[k] - n / 8) <= 2 for k in range(8))
    text = {i: t or "" for i, t, *_ in rows}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.size == len(text[r.doc_id].encode()) + 16 for r in got)


def test_fewer_rows_than_shards_and_none(spark):
    few = sharding.assign(spark.createDataFrame([(1, "a", "s", "", 0), (2, "b", "s", "", 0)], SCHEMA), 5).collect()
    assert len({r.shard for r in few}) == 2 and {r.slot for r in few} == {0}
    assert sharding.assign(spark.createDataFrame([], SCHEMA), 5).count() == 0


def test_equals_brute_force(spark):
    """Order within strata, interleaving and cuts by hand; ids tell rows apart."""
    rows = [(i, f"text {i % 13} " * (i % 5), ["big", "big", "s1", "s2", None][i % 5], "x", 1) for i in range(237)] + [(237, "long " * 300_000, "s1", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    mix = {r.doc_id: r.mix for r in df.select("doc_id", F.xxhash64(F.lit(17), "doc_id", "text").alias("mix")).collect()}
    place = []
    for source in {r[2] for r in rows}:
        own = sorted((r[0] for r in rows if r[2] == source), key=mix.get)
        place += [((k + 0.5) / len(own), mix[i], i) for k, i in enumerate(own)]
    order = [i for *_, i in sorted(place)]
    cuts = [k * len(rows) // 7 for k in range(8)]
    want = {i: (k, n) for k in range(7) for n, i in enumerate(order[cuts[k] : cuts[k + 1]])}
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.assign(df, 7).collect()} == want


def test_written_shards_hold_every_row(spark, tmp_path):
    rows = [(i, f"text {i}", "s", "x", i) for i in range(50)] + [(7, "text 7", "s", "x", 7)] * 3 + [(None, None, None, None, None)] * 2
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    sharding.write_shards(df, 4, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(repr, got.select(*df.columns).collect())) == sorted(map(repr, df.collect()))
    assert all(sorted(r.slots) == list(range(len(r.slots))) for r in got.groupBy("_shard").agg(F.collect_list("_slot").alias("slots")).collect())
    assert got.select("_shard").distinct().count() == 4
