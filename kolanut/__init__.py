"""Spark operators for preparing and judging conversational tool-call corpora."""
