"""Operators for training-data pipelines.  Nothing outside this folder imports it, apart from the guarded entry points."""
