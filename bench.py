"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from framelark.plans import registry
from framelark.session import local_session, reach_workers

HEADLINE = [
    "note_state_f1", "o056_rasterise", "o059_chord_flag", "o061_note_state", "o076_onset_matching", "o079_confusion", "o086_micro_rollup", "o047_lag_stack",
    "o051_thermometer_encode", "o054_pack_words", "o096_stratified_selection", "o101_threshold_calibration", "o115_class_sums", "o127_fit_ensemble",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    reach_workers(spark)
    registry.QUERIES["o089_source_counts"](spark, sf_dir).count()  # starts the session
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
