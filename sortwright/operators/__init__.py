"""DataFrame operators: ranking, rules, the decision cascade, clustering and metrics."""
