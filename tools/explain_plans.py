"""Print condensed physical plans (after execution, AQE final plans) of the
headline queries over a landed order-line table.

usage: python tools/explain_plans.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ordersight.operators import bundle as B  # noqa: E402
from ordersight.operators import clean as C  # noqa: E402
from ordersight.operators import kpis as K  # noqa: E402
from ordersight.operators import market as MK  # noqa: E402
from ordersight.plans import sqlpack  # noqa: E402
from ordersight.functions.text import WS_CHARS  # noqa: E402
from ordersight.session import get_session, scratch_path  # noqa: E402
from ordersight.sources.star import sales_view  # noqa: E402


NOTES = """Generated by `tools/explain_plans.py`. What to look for:

* ingest: one pipelined stage of broadcast hash joins (dimension tables are
  under the broadcast threshold here; at scale `orders`/`customer`/`part`
  exceed it and AQE plans sort-merge joins instead);
* KPI queries: `PushedFilters: [IsNotNull(amount), GreaterThan(amount,0.00)]`
  and a `ReadSchema` with only the needed columns; cleaning fused into the
  scan's codegen stage; distinct orders as partial/merge aggregates keyed by
  (group, order_id) before the final per-group aggregate;
* shares and thresholds as window aggregates over the per-state aggregate
  (one scan of the order lines), no cartesian or nested-loop join;
* the KPI cube: additive measures summed per combination of all dimensions
  (map-side combined), the grouping sets over that result; distinct orders from
  (dimension, value, order) triples made distinct map-side and shuffled once;
* windows (ranks) only above the per-state aggregate.
"""


def condensed(df) -> str:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("+- == Initial Plan ==")[0]
    plan = re.sub("Some\\([" + re.escape(WS_CHARS) + "]+\\)", "Some(<python-whitespace>)", plan)
    keep = []
    for line in plan.splitlines():
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r", \[plan_id=\d+\]", "", line)
        line = re.sub(r"Location: [^,]+, ", "", line)
        if len(line) > 180:
            line = line[:177] + "..."
        keep.append(line)
    return "\n".join(keep)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session("local[8]", shuffle_partitions=16)
    path = scratch_path(spark, f"plans-lines-{uuid.uuid4().hex[:8]}")
    sales_view(spark, sf_dir).write.parquet(path)
    lines = spark.read.parquet(path)
    valid = C.load_clean(lines)
    shown = {
        "star join -> canonical lines (ingest)": sales_view(spark, sf_dir),
        "scalar_kpis": K.scalar_kpis(valid),
        "revenue_by_state": K.revenue_by_state(valid),
        "market_model_v2 (one scan)": sqlpack.run(spark, "market_model_v2", C.sql_flags(lines)),
        "kpi_cube (for rules and checks)": B.kpi_cube(valid),
        "expansion_targets over the cube's state slice": MK.expansion_targets(
            B.kpi_bundle(valid).state_agg, 2, aggregated=True),
    }
    print(f"# Physical plans (final AQE plans, {os.path.basename(sf_dir)}, local[8])\n")
    print(NOTES)
    for name, df in shown.items():
        print(f"## {name}\n\n```\n{condensed(df)}\n```\n")
    spark.stop()


if __name__ == "__main__":
    main()
