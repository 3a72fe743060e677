"""Write PLANS.md: for every query of the inventory its exchanges, joins, windows and Python nodes, as
``explain`` has them with adaptive execution off, on the given tables (default sf0.01).

    python tools/plan_report.py [SF_DIR]
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from textprep.session import build_session  # noqa: E402

COLUMNS = (
    ("hash shuffles", r"Exchange hashpartitioning"),
    ("range", r"Exchange rangepartitioning"),
    ("single", r"Exchange SinglePartition"),
    ("broadcasts", r"BroadcastExchange"),
    ("merge joins", r"SortMergeJoin"),
    ("sort aggregates", r"SortAggregate"),
    ("windows", r"Window \["),
    ("generates", r"Generate "),
    ("Python", r"ArrowEvalPython|MapInArrow|MapInPandas|FlatMapGroups|FlatMapCoGroups"),
)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(app="plan-report")
    from textprep.plans import catalog

    catalog.load_all()
    rows = []
    for name, query in sorted(catalog.QUERIES.items()):
        df = query(spark, sf_dir)  # side tables are built with adaptive execution on
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        rows.append([name, *[str(len(re.findall(pattern, plan))) for _, pattern in COLUMNS]])
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("# PLANS\n\nWritten by `tools/plan_report.py`: the last job of each query (tables stored on the way are read, not counted).\n\n")
        f.write("| query | " + " | ".join(n for n, _ in COLUMNS) + " |\n|" + "---|" * (len(COLUMNS) + 1) + "\n")
        f.writelines("| " + " | ".join(r) + " |\n" for r in rows)
    spark.stop()


if __name__ == "__main__":
    main()
