"""Spark analytics for labelled image sets and classifier evaluation."""
