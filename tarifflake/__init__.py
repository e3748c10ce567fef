"""tarifflake: a dated supplier-rate library and its pricing jobs, as Spark DataFrame programs."""

__version__ = "0.1.0"
