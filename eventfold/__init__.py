"""Event-sourced order data on Spark: decode, fold, compact, retry and replay keyed logs."""
