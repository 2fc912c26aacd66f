"""Corpus analytics on Spark: text quality, dedup, splits, audits, selection and evaluation as DataFrame plans."""
