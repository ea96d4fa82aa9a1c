"""Parity-event analytics on PySpark: shots, detection events, error models and task statistics."""
