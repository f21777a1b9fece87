"""Composed plans (train, answer) and the query catalog used by the driver."""
