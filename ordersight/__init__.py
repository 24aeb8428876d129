"""ordersight: sales-order analytics expressed as Spark DataFrame / SQL jobs.

Layout
------
sources/    readers (parquet star schema, CSV exports) and sinks
functions/  column-expression helpers (cleaning, dates, flags, ranks, text)
operators/  DataFrame -> DataFrame operators (cleaning, KPIs, audits, market
            model, insight rules, checks, BI sheets, report data, records,
            header mapping)
plans/      the SQL pack (spark.sql text), the query catalog used by
            ``__spark_entry__`` and the DuckDB oracle text
streaming/  Structured Streaming jobs over arriving CSV files
"""

from ordersight.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
