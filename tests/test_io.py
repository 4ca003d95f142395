"""Readers, writers and streams on small files."""

import json

from pyspark.sql import functions as F

from orelode.functions.keys import empty_to_null, validate_not_null
from orelode.operators import health, keyed
from orelode.session import settle
from orelode.sources import readers, writers
from orelode.streaming import feeds


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_universe_map_and_items(spark, tmp_path):
    by_symbol = {"aem": {"name": "Agnico", "metal": "gold", "queries": ["q"], "cik": "1"}, "X": {"companyName": "Ex", "type": "etf"},
                 "AEM": {"name": "Agnico Eagle", "metal": "gold"}}
    got = {r["symbol"]: r for r in readers.read_universe(spark, put(tmp_path / "u.json", json.dumps(by_symbol, indent=1))).collect()}
    assert set(got) == {"AEM", "X"} and got["AEM"]["name"] == "Agnico Eagle"
    assert (got["X"]["name"], got["X"]["metal"], got["X"]["company_type"]) == ("Ex", "unknown", "etf")
    items = {"items": [{"symbol": "nem", "metalFocus": "gold"}, {"name": "no symbol"}]}
    rows = readers.read_universe(spark, put(tmp_path / "i.json", json.dumps(items))).collect()
    assert [(r["symbol"], r["name"], r["metal"]) for r in rows] == [("NEM", "NEM", "gold")]


def test_companies(spark, tmp_path):
    lines = [{"symbol": "A", "name": "Short", "company": "Long", "metal": "gold"}, {"symbol": "B", "name": ""}]
    path = put(tmp_path / "c.json", "\n".join(map(json.dumps, lines)))
    got = {r["symbol"]: (r["company_name"], r["short_name"], r["metal"]) for r in readers.read_companies(spark, path).collect()}
    assert got == {"A": ("Long", "Short", "gold"), "B": ("B", "B", "")}


def test_homepages_list_and_profiles(spark, tmp_path):
    rows = [{"symbol": "a", "homepage_url": "u1", "status": "found"}, {"symbol": "A", "homepage_url": "u2", "status": "found"},
            {"symbol": "B", "homepage_url": "", "status": "found"}, {"symbol": "C", "homepage_url": "u", "status": "not_found"}]
    for name, doc in (("l.json", rows), ("p.json", {"profiles": rows})):
        got = [tuple(r) for r in readers.read_homepages(spark, put(tmp_path / name, json.dumps(doc))).collect()]
        assert got == [("A", "u2")]


def test_runs(spark, tmp_path):
    doc = {"workflow_runs": [{"id": 5, "status": "completed", "conclusion": "success", "created_at": "2024-01-01T00:00:00Z",
                              "updated_at": "2024-01-01T00:01:00Z", "head_sha": "s", "head_branch": "main"}]}
    put(tmp_path / "r" / "a.yml.json", json.dumps(doc))
    row = readers.read_runs(spark, str(tmp_path / "r")).first()
    assert (row["workflow_file"], row["id"], row["branch"]) == ("a.yml", 5, "main")
    assert str(row["updated_at"]) == "2024-01-01 00:01:00" and row["run_started_at"] is None


def test_table_outputs(spark, tmp_path):
    put(tmp_path / "t" / "a.json", '{"results": [{"row_count": 2, "latest_data_at": "2024-01-01"}]}')
    put(tmp_path / "t" / "b.json", "{}")
    put(tmp_path / "t" / "b.err", "no such table\n")
    got = {r["table"]: r for r in health.parse_table_stats(readers.read_table_outputs(spark, str(tmp_path / "t"))).collect()}
    assert got["a"]["row_count"] == 2 and got["a"]["error"] is None
    assert got["b"]["error"].strip() == "no such table"


def test_pages_with_bad_bytes(spark, tmp_path):
    df = spark.createDataFrame([("e.com/a#x", bytearray(b"ok\xff"))], "url string, html binary")
    df.write.parquet(str(tmp_path / "p"))
    row = readers.read_pages(spark, str(tmp_path / "p")).first()
    assert (row["url"], row["html"]) == ("https://e.com/a", "ok�")


def test_videos_and_segments(spark, tmp_path):
    def item(v, title="t"):
        return {"snippet": {"title": title, "publishedAt": "p", "channelTitle": "c", "resourceId": {"videoId": v}}}

    lines = [{"channel_id": "C", "page": 0, "items": [item("a"), item(""), item("b")]}, {"channel_id": "C", "page": 1, "items": [item("d")]}]
    got = readers.read_videos(spark, put(tmp_path / "v.json", "\n".join(map(json.dumps, lines)))).orderBy("position").collect()
    assert [r["video_id"] for r in got] == ["a", "b", "d"] and got[0]["video_url"] == "https://www.youtube.com/watch?v=a"
    seg = {"video_id": "a", "language": "en", "is_generated": True, "segments": [{"start": 0, "duration": 1, "text": "x"}, {"text": "y"}]}
    rows = readers.read_segments(spark, put(tmp_path / "s.json", json.dumps(seg))).collect()
    assert [(r["pos"], r["text"]) for r in rows] == [(0, "x"), (1, "y")]


def test_writers_and_null_rule(spark, tmp_path):
    df = spark.createDataFrame([("a", "", 0), ("b", "x", 1)], "z string, s string, n int")
    writers.write_table(df, str(tmp_path / "t"))
    assert {r["z"]: (r["s"], r["n"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {"a": (None, 0), "b": ("x", 1)}
    writers.write_json(df, str(tmp_path / "j"), sorted_keys=True)
    line = spark.read.text(str(tmp_path / "j")).first()["value"]
    assert list(json.loads(line)) == ["n", "s", "z"]
    writers.append_records(df, str(tmp_path / "a"))
    writers.append_records(df, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 4
    assert validate_not_null(empty_to_null(df), ["s"]).count() == 1


def test_settle(spark):
    assert settle(spark.range(10).coalesce(1), "x").count() == 10


def split_files(spark, sf, folder, n=4):
    spark.read.parquet(f"{sf}/events.parquet").repartitionByRange(n, "ts").write.parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_upsert_stream_equals_batch_upsert(spark, sf, tmp_path):
    stream = split_files(spark, sf, str(tmp_path / "in")).select("user_id", "event_type", "event_id")
    folder = str(tmp_path / "out")
    feeds.upsert_stream(stream, folder, ["user_id"], "event_id").awaitTermination()
    got = {tuple(r) for r in feeds.current_rows(spark, folder, ["user_id"], "event_id").select("user_id", "event_type", "event_id").collect()}
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_type", "event_id")
    none = events.limit(0).withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("updated_at", F.col("created_at"))
    whole = keyed.upsert(none, events.withColumn("seq", F.col("event_id")), ["user_id"], "2024-02-01T00:00:00Z", arrival="seq")
    assert got == {tuple(r) for r in whole.select("user_id", "event_type", "event_id").collect()}
    # nothing new: a second run adds nothing
    feeds.upsert_stream(stream, folder, ["user_id"], "event_id").awaitTermination()
    assert feeds.current_rows(spark, folder, ["user_id"], "event_id").count() == len(got)


def test_once_only_across_batches(spark, sf, tmp_path):
    stream = split_files(spark, sf, str(tmp_path / "in")).select(
        F.col("user_id").cast("string").alias("video_id"), F.col("ts").cast("timestamp").alias("seen_at"))
    feeds.append_stream(feeds.once_only(stream, "seen_at", "60 days"), str(tmp_path / "out")).awaitTermination()
    rows = [r["video_id"] for r in spark.read.parquet(str(tmp_path / "out" / "rows")).collect()]
    users = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()
    assert len(rows) == len(set(rows)) == users


def test_freshness_over_batches(spark, sf, tmp_path):
    folder = str(tmp_path / "out")
    feeds.freshness_stream(split_files(spark, sf, str(tmp_path / "in")), folder, "event_type", "ts").awaitTermination()
    got = {r["feed"]: (r["row_count"], r["latest_data_at"]) for r in feeds.current_rows(spark, folder, ["feed"], "latest_data_at").collect()}
    want = spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").agg(F.count("*"), F.max("ts")).collect()
    assert got == {r[0]: (r[1], r[2]) for r in want}
