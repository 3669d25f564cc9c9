"""The catalogue: query name, Spark plan, oracle SQL."""
