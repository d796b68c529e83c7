"""Spark operators for building labelled cohorts and judging predictions on them."""
