"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from concord.queries import QUERIES  # noqa: E402
from concord.session import local_session  # noqa: E402

# One or more per section: the operators whose cost grows with the data.
HEADLINE = """
a04_json_nodes a05_statements b02_number_equality b03_keyed_diff b04_nested_diff b06_array_diff b08_multiset_diff b11_first_and_total
b14_text_drift b16_merge_spans c01_align_sides c04_sweep_kinds c09_cap_per_file c10_disagreement_groups d01_synthetic_key d04_fold_groups
d11_choice_casing d17_resolve_references d19_rename e05_any_of e06_dangling_reference f02_monthly_means f06_audit_reserved g04_world
g06_ring_error h03_reconcile i01_unique_key i06_foreign_key j04_newest j06_standing j10_strangers k01_find_names k08_strangers l01_verdicts
l04_complete m01_conformance_run m03_monthly_check
""".split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench")
    times: dict[str, float] = {}
    spark.read.parquet(f"{sf}/nation.parquet").count()  # start the engine
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
