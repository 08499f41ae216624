"""All named queries of the engine, and the SQL that gives the same rows where SQL can."""

from . import fits, forecasts, market, news, reports, views

PARTS = (market, forecasts, fits, news, views, reports)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in PARTS for name, sql in part.SQL.items()}
FLAGSHIP = "wf_fold_metrics"
