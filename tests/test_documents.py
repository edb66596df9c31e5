from __future__ import annotations

import sqlite3
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillmetry.operators import documents as docs
from quillmetry.operators.changepoints import bocpd
from quillmetry.streaming import streams
from quillmetry.streaming.changepoints import online_breaks


def test_stable_ids_equal_the_library(spark):
    names = ["a", "Über", "", "https://x.example/1"]
    got = [r.u for r in spark.createDataFrame([(n,) for n in names], "n string").select(docs.stable_id(uuid.NAMESPACE_URL, F.col("n")).alias("u")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_clean_text_and_posts(spark):
    ok = '{"id": 7, "link": "https://x.example/a", "date_gmt": "2011-02-03T04:05:06", "title": {"rendered": "A &amp;  B"}, "content": {"rendered": "<p>One</p>\\n<p>ﬁne</p>"}}'
    df = spark.createDataFrame([(ok,), ("{broken",), (None,), ("{}",)], "j string")
    rows = docs.rest_posts(df, "j").collect()
    assert [(r.id, r.title, r.text) for r in rows] == [(7, "A & B", "One fine")] and rows[0].published_at.year == 2011


def test_generated_payloads():
    assert docs.parse_generated('```json\n{"headline": "H", "text": "T"}\n```') == ("H", "T")
    assert docs.parse_generated('Sure: {"article": {"headline": "H", "text": "T"}} done') == ("H", "T")
    assert docs.parse_generated("# Head\n\nBody") == ("Head", "Body")
    assert docs.parse_generated(None) == ("", "") and docs.parse_generated("{bad") == ("", "{bad")


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as con:
        con.execute("create table articles (id text, n int)")
        con.executemany("insert into articles values (?, ?)", [(f"a{i}", i) for i in range(100)])
        con.execute("create table none (id text, n int)")
    assert docs.read_sqlite(spark, path, "articles", "id string, n bigint").agg(F.sum("n")).first()[0] == 4950
    assert docs.read_sqlite(spark, path, "none", "id string, n bigint").count() == 0


def test_streamed_alarms_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(size=60), rng.normal(7, 1, 60)]
    for k in range(3):
        pd.DataFrame({"entity": 1, "i": range(40 * k, 40 * k + 40), "value": x[40 * k : 40 * k + 40]}).to_parquet(tmp_path / f"in{k}.parquet")
    stream = spark.readStream.schema("entity bigint, i bigint, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    q = online_breaks(stream).writeStream.format("memory").queryName("alarms").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(r["at"] for r in spark.sql("select * from alarms").collect())
    assert set(got) >= {at for at, _ in bocpd(x)}


def test_sessions_stream_like_the_batch(spark, tmp_path):
    pd.DataFrame({"u": [1, 1, 1, 2], "ts": pd.to_datetime(["2024-01-01 00:00", "2024-01-01 01:00", "2024-01-02 00:00", "2024-01-01 00:00"])}).to_parquet(tmp_path / "e.parquet", coerce_timestamps="us")
    batch = streams.sessions(spark.read.parquet(str(tmp_path)), "u", "ts", "6 hours")
    assert sorted((r.u, r.n) for r in batch.collect()) == [(1, 1), (1, 2), (2, 1)]
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path)).schema).parquet(str(tmp_path))
    assert streams.sessions(stream, "u", "ts", "6 hours").isStreaming and streams.first_seen(stream, "u", "ts").isStreaming
    assert streams.sliding_counts(spark.read.parquet(str(tmp_path)), "u", "ts").count() > 0
