"""tidemark: a Spark-first engine for versioned time series, quant analytics and corpus work."""

__version__ = "0.1.0"
