"""Leases: fencing by owner, late heartbeats, expiry by timers, dead letters, and no state of ended items."""

import datetime

from loomgraph.streaming.leases import lease_states

SCHEMA = "event_id long, item_id long, owner string, action string, ts timestamp"
T0 = datetime.datetime(2024, 1, 1)


def run(spark, tmp_path, batches):
    rows, n = [], 0
    src = tmp_path / "in"
    for i, batch in enumerate(batches):
        data = []
        for item, owner, action, second in batch:
            n += 1
            data.append((n, item, owner, action, T0 + datetime.timedelta(seconds=second)))
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        if i == 0:
            stream = lease_states(spark.readStream.schema(SCHEMA).parquet(str(src)))
        q = stream.writeStream.foreachBatch(lambda df, k: rows.extend(df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        last = [p for p in q.recentProgress if p["stateOperators"]]
    second = lambda r: (r["at"] - T0).total_seconds()
    return sorted((r["item_id"], second(r), r["status"], r["owner"], r["attempts"], r["rejected"]) for r in rows), last


def test_leases(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        got, last = run(spark, tmp_path, [
            # 1 is claimed, contested, kept alive and acked; 2 is left alone; 3 fails three times; 4's owner is late.
            [(1, "a", "claim", 0), (1, "b", "claim", 1), (1, "b", "ack", 2), (1, "a", "heartbeat", 50), (1, "a", "ack", 100), (2, "a", "claim", 0), (3, "a", "claim", 0), (3, "a", "fail", 1), (3, "b", "claim", 2), (3, "b", "fail", 3), (3, "a", "claim", 4), (3, "a", "fail", 5), (4, "a", "claim", 0)],
            [(4, "a", "heartbeat", 90), (4, "b", "claim", 95), (9, "z", "claim", 300)],
            [(9, "z", "ack", 310)],
        ])
        assert [r for r in got if r[0] == 1] == [(1, 0.0, "claimed", "a", 1, 0), (1, 100.0, "succeeded", "a", 1, 2)]
        assert [r for r in got if r[0] == 2] == [(2, 0.0, "claimed", "a", 1, 0), (2, 60.0, "retrying", "a", 1, 0)]
        assert [r[2] for r in got if r[0] == 3] == ["claimed", "retrying", "claimed", "retrying", "claimed", "dead_letter"]
        four = [r for r in got if r[0] == 4]
        assert four[0] == (4, 0.0, "claimed", "a", 1, 0) and ("claimed", "b", 2) in {r[2:5] for r in four} and four[-1][2:5] == ("retrying", "b", 2)
        assert [r[2] for r in got if r[0] == 9] == ["claimed", "succeeded"]
        # Ended items (1, 3, 9) have no state; 2 and 4 wait to be claimed again. Timers count as rows of their own and are gone.
        assert last[-1]["stateOperators"][0]["numRowsTotal"] == 2
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
