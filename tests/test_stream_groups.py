"""Streams whose users are taken together in groups."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from engram.streaming import captures as stream


@pytest.mark.parametrize("groups", [None, 2])
def test_users_in_groups(spark, tmp_path, groups):
    """In three runs the rows of the table form; each user's state ends by itself; texts do not reach Python, which took all columns, a user at a time, before."""
    pick, at, rows = random.Random(5), datetime(2024, 1, 1), []
    for i in range(240):
        at += timedelta(seconds=pick.choice([0, 20, 100, 600, 601]))
        rows.append((at, i, pick.choice([1, 2, 3, 4, None]), pick.choice(["Code", "Mail", "Electron"]), pick.choice(["x", "y", None]), pick.choice([0, 400_000]), pick.choice([0.1, 0.5, None]), 100, pick.choice(["text number one", "text number two", "short", None])))
    rows += [(at + timedelta(days=1, seconds=k), 240 + k, 9 - k, "Code", "x", 0, 0.1, 100, "text number one") for k in range(2)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, capture_id long, user_id long, app string, title string, idle_ms long, diff_ratio double, width int, ocr_raw string")
    own = ("capture_id", "app")
    for part in range(3):
        df.where(F.col("capture_id").between(part * 81, part * 81 + 80)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        gated = stream.gated_stream(source, forget=600, late="0 seconds", keep=own, groups=groups)
        assert gated.columns == [*own, "changed"]
        run = stream.store_batches(gated, f"{tmp_path}/out/run={part}", f"{tmp_path}/state", once=True)
        run.awaitTermination()
    sent = gated._jdf.queryExecution().analyzed().toString().split("TransformWithState")[1].splitlines()[1]
    assert "ocr_raw" not in sent and "width" not in sent and "diff_ratio" not in sent
    want = stream.gated(df, forget=600).select(*own, "changed")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(*own, "changed").collect())) == sorted(map(tuple, want.collect()))
    kept = spark.read.format("statestore").option("stateVarName", "last").load(f"{tmp_path}/state").collect()
    assert sorted(x.user_map_key[0] if "user_map_key" in x else x.map_key[0] for x in kept) == ['{"user_id":8}', '{"user_id":9}']
    assert groups is None or {x.key[0] for x in kept} <= set(range(groups))
