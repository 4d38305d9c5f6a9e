"""Inputs and outputs: raw batches, the day-partitioned log table, synthetic logs."""
