from grovespark.streaming import ref_log as S
from tests.conftest import rows

SF = "/root/testdata/sf0.001/events.parquet"


def stream(spark, tmp_path, parts=3):
    source = str(tmp_path / "in")
    spark.read.parquet(SF).repartition(parts).write.parquet(source)
    return S.from_events(spark.readStream.schema(spark.read.parquet(SF).schema).option("maxFilesPerTrigger", 1).parquet(source))


def test_state_agrees_with_batch(spark, tmp_path):
    seen = {}

    def hook(batch, number):
        seen.update({r["name"]: (r["op"], r["oid"]) for r in batch.collect()})

    S.follow(stream(spark, tmp_path), hook, str(tmp_path / "c")).awaitTermination()
    want = {r["name"]: (r["op"], r["oid"]) for r in S.live(S.from_events(spark.read.parquet(SF))).collect()}
    assert seen == want and sum(op == "write" for op, _ in want.values()) == 12


def test_windows_agree_with_batch(spark, tmp_path):
    log = stream(spark, tmp_path, 1)
    q = S.windowed(log).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("w")) == rows(S.windowed(S.from_events(spark.read.parquet(SF))))


def test_transitions(spark, tmp_path):
    q = S.transitions(stream(spark, tmp_path, 1)).writeStream.format("memory").queryName("t").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    last, count = {}, 0
    for r in sorted(S.from_events(spark.read.parquet(SF)).collect(), key=lambda r: (r["ts"], r["seq"])):
        new = r["oid"] if r["op"] == "write" else None
        count += new != last.get(r["name"])
        last[r["name"]] = new
    got = spark.table("t").orderBy("ts", "seq").collect()
    assert len(got) == count
    end = {r["name"]: r["new_oid"] for r in got}
    assert end == {k: v for k, v in last.items() if k in end}
