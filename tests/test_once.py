"""What a rule or a form reads is worked out once, and a text is not tried in vain."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from colloquy.functions import dates, text, times
from colloquy.operators import vectors


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_due_times(spark):
    said = {
        "2024-07-01T10:30": "2024-07-01 14:30:00", "2024-7-1t1:2:3": "2024-07-01 05:02:03", "2024-01-01 0:0": "2024-01-01 05:00:00", "2024-03-10T02:30": None, "2024-11-03T01:30": None,
        "2024-02-30T10:00": None, "01.02.2024": None, "2024-01-01": None, "": None, None: None, " 2024-01-01 0:0": None, "2024-01-01T10:61": None,
    }
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(said)], "k int, t string").select("k", times.asked_due(F.concat("t", F.lit("")), "America/New_York").alias("due"))
    assert [r.due for r in rows.orderBy("k").collect()] == list(said.values())
    assert planned(rows).count("gettimestamp") == 3 and planned(rows).count("concat(") == 1


def test_letters(spark):
    said = ["漢字かな", "漢字", "abc", "ab", "", None, "Ünï 漢", "x" * 200_000 + "漢" * 200_000]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(said)], "k int, t string").withColumn("n", text.letters(F.col("t")))
    found = rows.select("n.*", *[text.written_as(F.col("n"), x).alias(x) for x in ("en", "zh", "ja")], *[text.looks_like(F.col("t"), x).alias(f"own_{x}") for x in ("en", "zh", "ja")]).collect()
    assert [tuple(r[:3]) for r in found] == [(0, 2, 2), (0, 2, 0), (3, 0, 0), (2, 0, 0), (0, 0, 0), (0, 0, 0), (3, 1, 0), (200_000, 200_000, 0)]
    assert all(r[3:6] == r[6:9] for r in found)
    one = spark.range(5).select(text.looks_like(F.col("id").cast("string"), "ja").alias("fits"))
    assert planned(one).count("regexp_replace") == 3


def test_dates_read_once(spark):
    rows = spark.range(5).select(dates.resolved(F.concat(F.lit("in "), F.col("id").cast("string"), F.lit(" days")), F.current_timestamp().cast("timestamp_ntz")).alias("due"))
    assert planned(rows).count("(am|pm|a\\.m|p\\.m)?") == 3 and planned(rows).count("(min|hour|day|week)") == 2


def test_meetings_are_bounded(spark):
    rng = np.random.default_rng(2)
    q, p = rng.normal(size=(1000, 8)), rng.normal(size=(90, 8))
    p[50:60] = p[:10]  # alike: the smaller id counts
    ids = rng.permutation(90)
    one = lambda x: pa.array([x.tolist()])
    batch = pa.RecordBatch.from_arrays([one(np.arange(1000)), one(q), one(ids), one(ids % 7), one(p)], names=["q_id", "q_embedding", "p_id", "p_speaker_id", "p_embedding"])
    for k in (1, 3):
        parts = list(vectors.meetings(k, False)(iter([batch])))
        assert max(b.num_rows for b in parts) <= vectors.AT_ONCE * k
        found = pa.Table.from_batches(parts).to_pydict()
        sims = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (p / np.linalg.norm(p, axis=1, keepdims=True)).T
        want = [ids[np.lexsort((ids, -np.round(s, 9)))[:k]].tolist() for s in sims]
        assert np.reshape(found["id"], (1000, k)).tolist() == want and found["query"] == np.repeat(np.arange(1000), k).tolist()
