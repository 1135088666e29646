"""Hot-key check from Spark's event log (not part of the pytest run).

Usage: python tests/skew_report.py [sf_dir]

A third of all login events is given to one user and a third of all cart
adds to one (cart, line) key: stand-in input, built only here. Then the
library's B10 and B02 (also with the hot user's events all within one hour, and the hot
key's changes spread over all of ``seq``) run next to the naive form (one window per key), with
the event log written to a fresh scratch folder. For every stage the report
gives the largest task's share of the stage's input records: 1/tasks when
the work is spread evenly, close to 1/3 or more when one task holds the
hot key.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def stage_shares(log_dir: str) -> dict[str, list[tuple[int, float]]]:
    """job description -> [(stage id, largest task share of records read)]."""
    files = sorted(f for f in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True) if os.path.isfile(f))
    stage_job, tasks = {}, defaultdict(list)
    for path in files:
        for line in open(path):
            if not line.startswith("{"):
                continue
            e = json.loads(line)
            kind = e.get("Event")
            if kind == "SparkListenerJobStart":
                desc = (e.get("Properties") or {}).get("spark.job.description", "")
                for sid in e.get("Stage IDs", []):
                    stage_job[sid] = desc
            elif kind == "SparkListenerTaskEnd":
                m = e.get("Task Metrics") or {}
                rec = (m.get("Input Metrics", {}).get("Records Read", 0)
                       + m.get("Shuffle Read Metrics", {}).get("Total Records Read", 0))
                tasks[e["Stage ID"]].append(rec)
    out = defaultdict(list)
    for sid, recs in sorted(tasks.items()):
        total = sum(recs)
        if total and stage_job.get(sid):
            out[stage_job[sid]].append((sid, round(max(recs) / total, 3), len(recs), total))
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="tillroll-eventlog-")
    from tillroll.operators import writes
    from tillroll.session import build_session
    from tillroll.sources.fixtures import PosTables
    spark = build_session(shuffle_partitions=16, extra={"spark.eventLog.enabled": "true",
                                                          "spark.eventLog.dir": log_dir, "spark.eventLog.compress": "false",
                                                          "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    t = PosTables(spark, sf_dir, store=False)
    hot_logins = t.login_events.withColumn(
        "user_id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")))
    hot_adds = t.cart_adds.withColumn("cart_id", F.when(F.col("seq") % 3 == 0, F.lit(1)).otherwise(F.col("cart_id"))) \
        .withColumn("product_id", F.when(F.col("seq") % 3 == 0, F.lit(1)).otherwise(F.col("product_id"))) \
        .withColumn("addon_id", F.when(F.col("seq") % 3 == 0, F.lit(1)).otherwise(F.col("addon_id")))

    def run(desc, df):
        spark.sparkContext.setJobDescription(desc)
        df.write.format("noop").mode("overwrite").save()

    # The same hot user with all its events within one hour, and a key whose changes are spread over all of seq.
    one_hour = F.timestamp_add("MICROSECOND", (F.col("id") % 3_600_000_000).cast("bigint"), F.lit("2024-01-05 10:00:00").cast("timestamp_ntz"))
    burst = hot_logins.withColumn("ts", F.when(F.col("user_id") == 0, one_hour).otherwise(F.col("ts")))
    spread = hot_adds.withColumn("seq", F.when(F.col("cart_id") == 1, F.col("seq") * 1_000_003).otherwise(F.col("seq")))
    run("B10 library", writes.sessionize_logins(hot_logins))
    run("B10 library, hot user within one hour", writes.sessionize_logins(burst))
    run("B02 library, hot key over all of seq", writes.merge_cart_lines(spread))
    w = Window.partitionBy("user_id").orderBy("ts", "id")
    run("B10 naive window per user", hot_logins.select("*", F.lead("ts").over(w).alias("n")))
    run("B02 library", writes.merge_cart_lines(hot_adds))
    w2 = Window.partitionBy("cart_id", "product_id", "addon_id").orderBy("seq")
    run("B02 naive window per key", hot_adds.select("*", F.sum("change").over(w2).alias("s")))
    spark.stop()
    report = {desc: [{"stage": s, "max_task_share": share, "tasks": n, "records": total}
                     for s, share, n, total in stages]
              for desc, stages in stage_shares(log_dir).items()}
    print(json.dumps(report, indent=1))


if __name__ == "__main__":
    main(sys.argv)
