"""Agent memories as tables: ingest, search, consolidation, graph and profiles on Spark."""
