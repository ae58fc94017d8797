"""Training-data operators. Nothing outside this subpackage imports it except the guarded lines of `__spark_entry__.py`."""
