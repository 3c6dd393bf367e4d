"""Readers and writers for transactions, alerts, model artifacts and message streams."""
