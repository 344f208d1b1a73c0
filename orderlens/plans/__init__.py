"""The query catalogue: KPI queries, business cases, chart data, statistics, the ETL job."""
