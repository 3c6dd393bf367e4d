"""DataFrame operators: features, alerts, reports, evaluation, sampling and models."""
