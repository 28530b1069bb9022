"""Times the headline queries and prints one JSON line.

Reads `BENCH_SF_DIR` (default /root/testdata/sf0.1) on `local[BENCH_CPUS]` (default 8). The given tables are one row group
each, which is one task; a large table has many. So they are first written again as four files per core, and the
queries read that copy. Each query runs once to warm up and is then timed; results go to the no-op sink. Besides seconds
there are CPU seconds, of the JVM and all Python workers, which tell more work from fewer cores.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import functions as F

from civiltext.plans import all_queries, inputs
from civiltext.operators import classifiers, cleaning, dedup, evaluation
from civiltext.session import build_session, clear_scratch

HEADLINES = (
    "cleaned_documents", "cleaned_pages", "toxicity_after_cleaning", "rule_impact", "length_histogram",
    "minhash_signatures", "deduplicated_documents", "split_rows", "balanced_train", "vocabulary",
    "average_precision", "threshold_sweep", "tuned_metrics", "external_model_scores",
)


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


TABLES = ("documents", "labels", "pages", "conversations")


def _cpu_seconds() -> float:
    """CPU time of this process, of all below it, and of those that have ended."""
    stats, below = {}, {os.getpid()}
    for name in filter(str.isdigit, os.listdir("/proc")):
        try:
            with open(f"/proc/{name}/stat", encoding="utf-8", errors="replace") as file:
                fields = file.read().rpartition(")")[2].split()
        except OSError:
            continue
        stats[int(name)] = (int(fields[1]), sum(map(int, fields[11:15])))
    grown = True
    while grown:
        found = {pid for pid, (parent, _) in stats.items() if parent in below} - below
        below |= found
        grown = bool(found)
    return sum(stats[pid][1] for pid in below if pid in stats) / os.sysconf("SC_CLK_TCK")


def _spread(spark, sf_dir: str, folder: str, files: int) -> str:
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(files).write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    size = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    copy = tempfile.TemporaryDirectory(prefix="bench-")
    sf_dir = _spread(spark, sf_dir, copy.name, 4 * int(cpus))
    # by default Spark packs such small files into few tasks
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))
    queries, seconds, busy = all_queries(), {}, {}
    for name in HEADLINES:
        for _ in range(2):
            start, before = time.perf_counter(), _cpu_seconds()
            _run(queries[name](spark, sf_dir))
            seconds[name] = round(time.perf_counter() - start, 3)
            busy[name] = round(_cpu_seconds() - before, 1)

    # the whole path on the labelled texts: clean, deduplicate, split, fit
    start, before = time.perf_counter(), _cpu_seconds()
    kept = dedup.deduplicate(cleaning.clean_text(inputs.noisy_corpus(spark, sf_dir)))
    parts = inputs.make_splits(dedup.cut_lineage(kept))
    model = classifiers.logreg_fit(parts.filter("split = 'train'"))
    seconds["corpus_to_model"] = round(time.perf_counter() - start, 3)
    busy["corpus_to_model"] = round(_cpu_seconds() - before, 1)

    # whole documents, and their lines, which are about as long as a comment
    speeds = {}
    texts = inputs.documents(spark, sf_dir).repartition(4 * int(cpus))
    lines = texts.select(F.explode(F.split("text", "\n")).alias("text"))
    for name, rows in (("documents", texts.select("text")), ("lines", lines)):
        rows = rows.persist()
        n, chars = rows.agg(F.count("*"), F.sum(F.length("text"))).first()
        best = evaluation.timed_runs(model, rows, 3, name).agg({"seconds": "min"}).first()[0]
        seconds[f"score_{name}"] = round(best, 3)
        speeds[name] = {"rows": n, "rows_per_second": round(n / best, 1), "characters_per_second": round(chars / best)}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "cpu_seconds": busy, "sf": size,
        "scored_rows": speeds["documents"]["rows"], "scored_rows_per_second": speeds["documents"]["rows_per_second"],
        "scoring": speeds, "cores": int(cpus),
    }))
    clear_scratch(spark)
    copy.cleanup()


if __name__ == "__main__":
    main()
