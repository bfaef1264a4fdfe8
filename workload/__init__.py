"""Driver workload: raw payloads shaped from the base tables, queries, oracle SQL."""
