import glob
import os
import time

from pyspark.sql import functions as F

from threatloom.operators import reputation, results
from threatloom.plans.analysis import corpus_verdicts
from threatloom.sources import store
from threatloom.streaming import jobs


def test_feedback_batches_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "feedback")
    parents = spark.createDataFrame([(1,), (2,)], "msg_id bigint")
    new = spark.createDataFrame([(1, "uncertain", 10), (3, "uncertain", 11), (2, "no such verdict", 12)], "msg_id bigint, verdict string, id bigint")
    for batch in ("a", "a", "b"):
        store.append_feedback(new, parents, path, batch)
    rows = sorted((r["batch"], r["msg_id"], r["id"], r["reviewed"]) for r in store.read_feedback(spark, path).collect())
    assert rows == [("a", 1, 10, 0), ("b", 1, 10, 0)]
    new.write.parquet(f"{path}/rows/batch=unfinished")  # a batch without its line in the manifest
    assert store.read_feedback(spark, path).count() == 2


def test_delete_writes_only_partitions_with_doomed_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, i % 4, f"x{i}") for i in range(40)], "msg_id bigint, part int, v string").write.partitionBy("part").parquet(path)
    files = lambda p: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/part={p}/*.parquet")}
    before = {p: files(p) for p in range(4)}
    time.sleep(0.05)
    doomed = spark.createDataFrame([(i,) for i in (1, 5, 9, *range(2, 40, 4))], "msg_id bigint")
    for _ in range(2):
        store.delete_cascade(doomed, path, "part")
        left = sorted(r["msg_id"] for r in spark.read.parquet(path).collect())
        assert left == [i for i in range(40) if i not in (1, 5, 9) and i % 4 != 2]
    assert files(0) == before[0] and files(3) == before[3] and files(1) != before[1] and not files(2)


def test_as_of_carries_the_last_fresh_answer(spark):
    at = lambda m: f"2024-01-01 {9 + m // 60:02d}:{m % 60:02d}:00"
    asked = [(i, "domain", "d.example", at(m)) for i, m in enumerate((0, 59, 60, 61, 90, 119, 120, 121, 200))]
    wanted = spark.createDataFrame(asked, "msg_id bigint, kind string, target string, t string").withColumn("created_at", F.to_timestamp("t"))
    told = [("VirusTotal", 60, 2), ("VirusTotal", 90, 0), ("AbuseIPDB", 61, 0)]
    feed = spark.createDataFrame([(p, "domain", "d.example", at(m), bad, 0, 0.0, 0, None) for p, m, bad in told],
                                 "provider string, kind string, target string, feed_ts string, malicious int, suspicious int, score double, listed int, registered string")
    got = sorted((r["msg_id"], r["provider"], r["verdict"]) for r in reputation.as_of(wanted, feed).collect())
    want = []
    for i, _, _, t in asked:
        now = int(t[11:13]) * 60 + int(t[14:16]) - 540
        for p in ("AbuseIPDB", "VirusTotal"):
            fresh = [(m, bad) for q, m, bad in told if q == p and m <= now < m + 60]
            want += [(i, p, "malicious" if max(fresh)[1] >= 2 else "clean")] if fresh else []
    assert got == sorted(want)


def test_lookups_follow_the_last_one_however_batches_are_cut(spark, tmp_path):
    minutes = {"a": (59, 61, 118, 119, 130, 179, 300), "b": (10, 69, 70, 400)}
    events = [(k, f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00") for k, ms in minutes.items() for m in ms] + [("z", "2024-01-01 09:00:00")]
    made = []
    for name, cuts in (("one", [events]), ("many", [sorted(events, key=lambda e: e[1])[i:i + 3] for i in range(0, len(events), 3)])):
        source = str(tmp_path / name)
        for cut in cuts:
            spark.createDataFrame(cut, "k string, t string").selectExpr("k", "to_timestamp(t) AS t").coalesce(1).write.mode("append").parquet(f"{source}/in")
        stream = spark.readStream.schema("k string, t timestamp").option("maxFilesPerTrigger", 1).parquet(f"{source}/in")
        jobs.to_table(jobs.lookups_within(stream, "t", ["k"]), f"{source}/out", f"{source}/cp")
        made.append(sorted((r["k"], r["asked_at"].hour * 60 + r["asked_at"].minute) for r in spark.read.parquet(f"{source}/out").collect()))
    # 59 asks; 61 and 118 do not, 119 does; 130 does not, 179 does.
    assert made[0] == made[1] == [("a", 59), ("a", 119), ("a", 179), ("a", 300), ("b", 10), ("b", 70), ("b", 400)]


def test_verdicts_take_a_folder_a_month(spark, sf, tmp_path):
    path = str(tmp_path / "store")
    store.write_verdicts(corpus_verdicts(spark, sf).where("msg_id < 150"), path)
    v, f = store.read_verdicts(spark, path), store.read_findings(spark, path)
    days = v.select("day").distinct().count()
    assert days > 3 and v.count() == spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 150").count()
    for name in ("verdicts", "findings"):
        assert [os.path.basename(p) for p in glob.glob(f"{path}/{name}/month=*")] == ["month=2024-01-01"]
    assert f.where("month <> trunc(day, 'MM') OR day <> to_date(created_at)").count() == 0
    wanted = "created_at >= timestamp'2024-01-02' AND created_at < timestamp'2024-01-04'"
    assert sorted(results.date_range(v, "2024-01-02", "2024-01-03").select("msg_id").collect()) == sorted(v.where(wanted).select("msg_id").collect())


def test_a_batch_of_messages_is_not_kept_in_the_executors(spark, sf, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from threatloom import fixtures as fx
    from threatloom.plans import stream_queries as Q
    from threatloom.streaming import jobs
    cached = []

    def seen(rows, path, batch=None):
        cached.append("InMemoryRelation" in rows._jdf.queryExecution().withCachedData().toString())
        rows.select("msg_id", "classification").write.mode("overwrite").parquet(f"{path}/batch={batch}")
    monkeypatch.setattr(jobs, "write_verdicts", seen)
    few = Q.arriving(spark, sf).where("msg_id < 20")
    jobs.score_messages(Q._as_stream(spark, few, str(tmp_path)), fx.dim(spark, "dim_reputation"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert cached == [False]
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == few.count() == got.agg(F.countDistinct("msg_id")).first()[0]
