"""DataFrame operators: filter, list, count, validate, acknowledge, rank, measure."""
