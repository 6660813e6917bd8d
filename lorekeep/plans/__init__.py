"""Plans: the operators applied to the store's tables, registered as queries with their SQL."""
