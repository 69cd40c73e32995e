"""rankaudit: blinded ranking benchmarks over large candidate tables, on Spark."""

__version__ = "0.1.0"
