"""The retry loops over a stream of attempts give the rows of the batch fold."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from quillgraph.operators import retry
from quillgraph.streaming import retries

START = datetime.datetime(2024, 1, 1)


def scripts(n=60):
    rng = random.Random(3)
    rows = []
    for q in range(n):
        condition = rng.choice(["baseline", "schema_linked", "disambiguation_enhanced", "disambiguation_enhanced"])
        choices = rng.choice([None, ["x", "y"], ["x", "x", "y", "z", "w"]])
        linked, ambiguous, limit = rng.random() > 0.1, rng.random() > 0.5, rng.choice([None, None, 2])
        for step in range(1, rng.randrange(2, 16)):
            verdict = rng.choice(["accept", "syntax", "schema", "schema"])
            outcome = rng.choice(["correct", "wrong_result", "wrong_result"]) if verdict == "accept" else None
            rows.append((f"q{q}", step, START + datetime.timedelta(minutes=step), condition, verdict, outcome, linked, ambiguous, limit, choices))
    return rows


def test_same_rows_as_the_batch_fold(spark, tmp_path):
    """Attempts dealt over five files, those of a question out of order among them; a last row moves the watermark on."""
    rows = scripts()
    batch = spark.createDataFrame(rows, retries.ATTEMPT)
    want = {r["question_id"]: r for r in retry.run(batch).collect()}
    rng = random.Random(4)
    files = [[] for _ in range(5)]
    for r in rows:
        files[min(4, max(0, r[1] // 4 + rng.choice([-1, 0, 0, 1])))].append(r)
    late = START + datetime.timedelta(days=9)
    files.append([("zz", 1, late, "baseline", "accept", "correct", True, False, None, None)])
    files.append([("zz", 2, late, "baseline", "accept", "correct", True, False, None, None)])
    for i, part in enumerate(files):
        spark.createDataFrame(part, retries.ATTEMPT).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    schema = batch.schema
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        q = retries.final_states(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(240) and q.exception() is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(str(tmp_path / "out")).where(F.col("question_id") != "zz").collect()
    assert len(got) == len({r["question_id"] for r in got}) == len(want)
    for r in got:
        assert r.asDict() == want[r["question_id"]].asDict(), r["question_id"]
    assert {r["reason"] for r in got} >= {"max_syntax_retries_exhausted", "max_schema_retries_exhausted", "schema_linker_no_valid_beams", None}
