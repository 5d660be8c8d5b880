"""Training-data operators: packing, deduplication, sharding, token counts, search and scans."""
