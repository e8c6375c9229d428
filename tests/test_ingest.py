import os

from pyspark.sql import functions as F

from tessella.sources import ingest, shared


def test_uploads_are_stamped_or_turned_away(spark, tmp_path):
    (tmp_path / "in" / "deep er").mkdir(parents=True)
    for name, size in {"a.svs": 10, "b.TIFF": 11, "deep er/c d.tif": 9, "d.exe": 1, "noext": 1, "e.ndpi": 0, ".mrxs": 3, "f.tar.tif": 5, "übung.svs": 2}.items():
        (tmp_path / "in" / name).write_bytes(b"x" * size)
    rows = ingest.uploads(spark, str(tmp_path / "in"), most=10, at_ms=F.lit(7))
    assert {r["name"]: r["reason"] for r in rows.collect()} == {"a.svs": None, "b.TIFF": "size", "c d.tif": None, "d.exe": "format", "noext": "format", "f.tar.tif": None, "übung.svs": None}
    assert "content" not in rows._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    good, bad = ingest.accepted_and_rejected(rows)
    assert {r["stamped"] for r in good.collect()} >= {"7-a.svs", "7-c d.tif"} and bad.count() == 3
    local = good.withColumn("path", F.expr("url_decode(path)"))
    stored = ingest.taken_in(local, str(tmp_path / "out")).collect()
    assert sorted(r["length"] for r in stored) == [2, 5, 9, 10] and sorted(p.stat().st_size for p in (tmp_path / "out").rglob("7-*")) == [2, 5, 9, 10]
    assert ingest.uploads(spark, str(tmp_path / "in"), "*.svs").count() == 2
    spark.conf.set(ingest.SETTING, "EXE, .svs")
    try:
        assert {r["name"] for r in ingest.uploads(spark, str(tmp_path / "in")).filter("reason is null").collect()} == {"a.svs", "d.exe", "übung.svs"}
    finally:
        spark.conf.unset(ingest.SETTING)


def test_one_pass_takes_in_and_turns_away(spark, tmp_path, capsys):
    up = tmp_path / "up"
    up.mkdir()
    for i in range(40):
        (up / f"s{i}{('.svs', '.txt')[i % 4 == 0]}").write_bytes(b"x" * (i + 1))
    rows = ingest.uploads(spark, str(up), most=30)
    assert rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    found = ingest.ingested(rows, str(tmp_path / "in"))
    found.explain()
    assert "Join" not in capsys.readouterr().out
    found = {r["name"]: r for r in found.collect()}
    assert len(found) == 40
    for i in range(40):
        r = found[f"s{i}{('.svs', '.txt')[i % 4 == 0]}"]
        reason = "format" if i % 4 == 0 else "size" if i >= 30 else None
        assert (r["reason"], r["copied"]) == (reason, None if reason else i + 1)
        assert (r["stored"] is None) == (reason is not None)
    assert len([p for p in (tmp_path / "in").rglob("*") if p.is_file() and not p.name.startswith(".")]) == sum(r["reason"] is None for r in found.values())


def test_tasks_list_what_spark_lists(spark, tmp_path, capsys):
    for name, size in {"a.svs": 3, "d/b.svs": 40, "d/e f/c.tif": 2, "d/e f/gone.tif": 0, "d/.hid.tif": 1, "_no/x.tif": 5, ".no/x.tif": 5, "k=1/y.tif": 4, "z/n.exe": 6}.items():
        (tmp_path / "up" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "up" / name).write_bytes(name[:1].encode() * size)
    (tmp_path / "up" / "empty").mkdir()
    at = dict(most=30, at_ms=F.lit(7))
    rows = ingest.uploads(spark, str(tmp_path / "up"), by_tasks=True, **at)
    facts = lambda found: sorted((r["name"], r["ext"], r["length"], r["stamped"], r["reason"] or "") for r in found.collect())
    assert facts(rows) == facts(ingest.uploads(spark, str(tmp_path / "up"), **at)) and len(facts(rows)) == 5
    assert facts(ingest.uploads(spark, str(tmp_path / "up"), "*.svs", by_tasks=True, **at)) == facts(ingest.uploads(spark, str(tmp_path / "up"), "*.svs", **at))
    rows.explain()
    assert "FileScan" not in capsys.readouterr().out  # whose listing the driver holds
    found = {r["path"].removeprefix(f"{tmp_path}/up/"): r for r in shared.listed(spark, str(tmp_path / "up"), "*.tif", content=True).collect()}
    assert {k: bytes(r["content"]) for k, r in found.items()} == {"d/e f/c.tif": b"dd", "k=1/y.tif": b"kkkk"}


def test_uploads_of_one_name_stay_apart(spark, tmp_path):
    for k in range(30):
        (tmp_path / "up" / f"d{k % 3}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "up" / f"d{k % 3}" / f"s{k // 3}.svs").write_bytes(b"x" * (k + 1))
    rows = ingest.uploads(spark, str(tmp_path / "up"), at_ms=F.lit(7), by_tasks=True)
    found = ingest.ingested(rows, str(tmp_path / "in")).collect()
    assert len({r["stored"] for r in found}) == 30 and all(os.path.getsize(r["stored"]) == r["copied"] == r["length"] for r in found)
    assert len(os.listdir(tmp_path / "in")) == 3  # a folder for each that uploads come from, not for each upload
