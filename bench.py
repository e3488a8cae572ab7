"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` names the tables and ``BENCH_CPUS`` the local cores. Every query is run to the end
into the no-op sink; the kNN join is also run on a larger table made from the embeddings. Times go to
the error stream as they come. A step that takes more than ``BENCH_STEP_SECONDS`` is cancelled and listed
as stopped, and no step begins after ``BENCH_SECONDS``, so the line is always printed.
"""

from __future__ import annotations

import json
import os
import sys
import threading
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from nearfield.operators.ann import assign_lists, train_lists  # noqa: E402
from nearfield.operators.knn import nearest  # noqa: E402
from nearfield.plans import catalogue  # noqa: E402
from nearfield.plans.inputs import DIM, base, queries  # noqa: E402
from nearfield.session import materialize, scratch_scope  # noqa: E402

HEADLINE = [
    "KN1_knn_euclidean", "KN1_knn_euclidean_blocks", "KN2_knn_cosine", "KN3_knn_equality",
    "KN4_knn_range", "KN5_knn_member", "KN8_all_ground_truths", "KN11_all_lists_is_exact",
    "KN14_reranked", "KN15_hash_search", "KN16_recall_sweep", "JN11_range_counts", "W1_contiguous_ids",
    "W3_shuffled", "W7_skippable_blocks", "SG4_range_filters", "AG4_latency_summary",
    "AG6_median_interval", "AG18_bucket_qps", "AG22_rate_at_recall", "SF9_error_report",
    "SF10_profile_rollup", "SK3_repack", "DR2_total_variance",
]
COPIES = 100


def run(df) -> float:
    started = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


class Steps:
    """Timed steps, each bounded."""

    def __init__(self, spark: SparkSession):
        self.context = spark.sparkContext
        self.limit = float(os.environ.get("BENCH_STEP_SECONDS", "150"))
        self.end = time.monotonic() + float(os.environ.get("BENCH_SECONDS", "1200"))
        self.times: dict[str, float] = {}
        self.stopped: dict[str, str] = {}

    def run(self, name: str, step: Callable[[], object]) -> object:
        """The step's result, or None if it failed, was cancelled or came too late."""
        if time.monotonic() > self.end:
            self.stopped[name] = "not begun"
            return None
        over = threading.Event()

        def cancel() -> None:  # again and again, as a step may begin another job
            while not over.wait(0 if late.is_set() else self.limit):
                late.set()
                self.context.cancelAllJobs()
                over.wait(1)

        late = threading.Event()
        watch = threading.Thread(target=cancel, daemon=True)
        watch.start()
        started = time.perf_counter()
        try:
            result = step()
            self.times[name] = round(time.perf_counter() - started, 3)
            print(f"{name} {self.times[name]}", file=sys.stderr, flush=True)
            return result
        except Exception as error:  # noqa: BLE001
            self.stopped[name] = f"after {self.limit:g} s" if late.is_set() else str(error).split("\n")[0][:200]
            print(f"{name} stopped: {self.stopped[name]}", file=sys.stderr, flush=True)
            return None
        finally:
            over.set()
            watch.join()


def larger_base(spark, sf):
    """The embeddings many times over, each copy shifted a little, as a written table."""
    copy = F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))
    rows = base(spark, sf).select("id", "emb").withColumn("copy", copy)
    shifted = F.transform("emb", lambda x: (x * (1 + F.col("copy") / 1000)).cast("float"))
    n = rows.count()
    moved = rows.repartition(32).select(
        (F.col("id") + F.col("copy") * n).alias("id"), shifted.alias("emb")
    )
    return materialize(moved, "larger"), n


def scoped(spark, step):
    """A step whose intermediate tables are gone when it ends."""
    with scratch_scope(spark):
        return step()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("nearfield-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    run(catalogue.QUERIES["KN1_knn_euclidean"](spark, str(Path(sf).parent / "sf0.001")))

    steps = Steps(spark)
    for name in HEADLINE:
        steps.run(name, lambda name=name: scoped(spark, lambda: run(catalogue.QUERIES[name](spark, sf))))

    rates, elements, recalls = {}, {}, {}
    made = steps.run("larger_base", lambda: larger_base(spark, sf))
    if made:
        rows, _ = made
        asked = queries(spark, sf).select("qid", "emb")
        pairs = rows.count() * asked.count()
        for form, sizes in (("scan", {}), ("blocks", {"broadcast_limit": 0})):
            name = f"knn_larger_{form}"
            if steps.run(name, lambda sizes=sizes: run(nearest(asked, rows, 10, **sizes))) is not None:
                rates[form] = round(pairs / steps.times[name])
        name = "lists_built_larger"

        def build() -> float:
            return run(assign_lists(rows, materialize(train_lists(rows, 200, iterations=5), "centres")))

        if steps.run(name, build) is not None:
            elements["lists_built"] = round(rows.count() * DIM / steps.times[name])
    elements |= {form: rate * DIM for form, rate in rates.items()}
    sweep = steps.run("recall_figures", lambda: catalogue.QUERIES["KN16_recall_sweep"](spark, sf).collect())
    for r in sweep or ():
        recalls[f"{r['quantisation']},n_probe={r['n_probe']},k={r['k']}"] = r["recall"]
    steps.times.pop("larger_base", None)
    steps.times.pop("recall_figures", None)
    times = steps.times
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(sf).name,
        "distance_evaluations_per_second": rates,
        "elements_per_second": elements,
        "recall": recalls,
        "stopped": steps.stopped,
    }))


main()
