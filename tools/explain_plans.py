"""Write the physical plans of the headline queries to PLANS.md.

    python tools/explain_plans.py [sf_dir]

Every stage is shown: the plan of each table that the query writes to the
shared folder on its way, in order, then the plan of its result, with the
number of exchanges. Long expression lines (the derived-listing CASE
expressions) are cut.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera import session  # noqa: E402
from tessera.registry import QUERIES  # noqa: E402
from tessera.session import local_session  # noqa: E402

HEADLINE = ["valid_groups", "invalid_files", "file_changes", "folder_stats", "incremental_blocks",
            "csv_layout"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def record_stages(stages: list):
    """Makes every module's ``materialize`` note the plan of what it writes."""
    write = session.materialize

    def noted(df, name="stage"):
        stages.append((name, plan_of(df)))
        return write(df, name)

    for module in list(sys.modules.values()):
        if getattr(module, "__name__", "").startswith("tessera") and getattr(module, "materialize", None) is write:
            module.materialize = noted


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8, 16)
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `tools/explain_plans.py` on `{os.path.basename(sf_dir)}` (local[8]); "
           "lines longer than 220 characters are cut.", ""]
    stages: list = []
    record_stages(stages)
    for name in HEADLINE:
        stages.clear()
        df = QUERIES[name](spark, sf_dir)
        shown = [*stages, ("result", plan_of(df))]
        exchanges = sum("Exchange " in ln and "Reused" not in ln for _, lines in shown for ln in lines)
        out += [f"## {name}", "", f"{len(shown)} stages, {exchanges} exchanges.", ""]
        for stage, lines in shown:
            out += [f"### {stage}", "", "```", *[ln if len(ln) <= 220 else ln[:220] + " ..." for ln in lines], "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
