"""Evaluation of structured extraction answers, and the table jobs around it, on Spark."""
