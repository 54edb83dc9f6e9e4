"""Time the headline queries and print one JSON line.

Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[BENCH_CPUS]``. Results
are fully computed but not kept; one unmeasured query warms the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

from corrobora.local import local_session
from corrobora.plans import all_queries
from corrobora.session import clear_run

HEADLINE = [
    "cell_qc_metrics",
    "normalised_counts",
    "variable_genes",
    "pseudobulk_expression",
    "context_stability",
    "leave_one_donor_out",
    "cross_study_concordance",
    "evidence_rule_counts",
    "gene_priorities",
    "matched_reference",
    "sampling_stability",
    "program_scores",
    "harmonised_variants",
    "colocalisation_posteriors",
    "credible_sets",
    "interval_hits",
    "loop_links",
    "nearest_neighbours",
    "graph_communities",
    "adjusted_p_single_family",
    "wide_count_text_scan",
    "triplet_count_scan",
    "evidence_matrix",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8)))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session("bench", cpus)
    found = all_queries()
    warm = found["evidence_rule_counts"](spark, folder)
    warm.write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        found[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    clear_run(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
