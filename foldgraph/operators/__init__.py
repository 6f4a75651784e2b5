"""DataFrame operators: records, graphs, windows, packing, checks, encoder."""
