"""Scene detection on streams whose batches bring events out of order."""

import datetime
import random

from tidemark.streaming import events as e

START = datetime.datetime(2024, 1, 1)


def plain(rows, threshold=0.1, min_length=5):
    out = []
    for user in {r[2] for r in rows}:
        n, last, luma = 0, 0, -1.0
        for event_id, _, _, value in sorted((r for r in rows if r[2] == user), key=lambda r: (r[1], r[0])):
            y = min(value, 500.0) / 500
            change = n == 0 or (n - last >= min_length and abs(y - luma) > threshold)
            out.append((user, event_id, n, change))
            last, n, luma = (n if change else last), n + 1, y
    return sorted(out)


def test_batches_out_of_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, START + datetime.timedelta(minutes=10 * (i // 2)), i % 5, rng.uniform(0, 700)) for i in range(400)]
    late = [(1000 + k, START + datetime.timedelta(minutes=5 * k), k % 5, 100.0) for k in range(7)]  # far behind when they come
    end = [(2000, START + datetime.timedelta(days=30), 99, 0.0)]
    moved = sorted(rows, key=lambda r: r[0] + rng.uniform(0, 60))  # at most five hours out of order
    schema = "event_id long, ts timestamp, user_id long, value double"
    cuts = [0, 90, 130, 260, 310, 400]
    batches = [moved[a:b] for a, b in zip(cuts, cuts[1:])]
    for batch in [*batches[:4], late, batches[4], end]:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = e.detect_scenes_in_order(e.read(spark, f"file://{tmp_path}/in", 1), late="6 hours")
    out, dropped = e.drained_counted(stream)
    got = sorted((r.user_id, r.event_id, r.n, r.change) for r in out.collect() if r.user_id != 99)
    assert got == plain(rows) and dropped == len(late)
