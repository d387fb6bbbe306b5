"""Times the headline queries; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from refspark.plans import registry

HEADLINE = ("minimum_slice", "d6_score_split", "d8_tail_metrics", "d17_resample_ohlc", "e1_e4_features", "e10_e12_cross_section", "f9_neutral_book", "f7_bracket_backtest", "c4_asof", "h2_lexical_score", "h20_d29_failure_clusters")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took, found = {}, registry.queries()
    for name in HEADLINE:
        best = None
        for _ in range(2):
            began = time.time()
            found[name](spark, sf).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf)}))
    spark.stop()


if __name__ == "__main__":
    main()
