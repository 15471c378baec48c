"""Storage, estimators and the registered queries."""
