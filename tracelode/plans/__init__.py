"""Query plans: the registered queries and their oracle SQL."""
