"""Tallyloom: timed text, event timelines and job bookkeeping as composable PySpark operators."""
