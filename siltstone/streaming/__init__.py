"""The streaming side: sources, windows, deduplication, fan-in with deadlines, dead letters."""
