"""DataFrame operators: quality control, joins, aggregation, metrics, sampling and windows."""
