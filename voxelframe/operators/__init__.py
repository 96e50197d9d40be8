"""Table-level operators: windows, nearest neighbours, matches, exchange, load and per-partition reduction."""
