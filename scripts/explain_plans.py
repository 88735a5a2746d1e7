"""Write the physical plans of the headline queries to PLANS.md.

Usage: python scripts/explain_plans.py [sf_dir]

Each plan is Spark's ``explain()`` output before execution (adaptive execution may still
change join sides and coalesce partitions at run time).  Lines are cut at 150 characters; the
unrolled 64-term distance expression would otherwise fill pages.
"""

from __future__ import annotations

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from proxima.plans.queries import QUERIES  # noqa: E402
from proxima.session import local_session  # noqa: E402

NAMES = ["classify_documents_quality", "knn_documents", "knn_documents_pivot",
         "classify_vectorized", "classify_vectorized_blocks", "distance_row", "knn_topk",
         "classify_broadcast_train", "dense_row_ordinal"]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8, shuffle_partitions=16)
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `scripts/explain_plans.py` on `{sf_dir}` (`local[8]`). Plans are taken",
           "before execution; lines are cut at 150 characters.", ""]
    for name in NAMES:
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            QUERIES[name](spark, sf_dir).explain()
        lines = [ln[:150] + (" …" if len(ln) > 150 else "") for ln in buf.getvalue().splitlines()
                 if ln.strip()]
        out += [f"## `{name}`", "", "```"] + lines + ["```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
