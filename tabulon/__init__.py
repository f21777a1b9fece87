"""tabulon: table analytics (cleaning, profiling, rule models, retrieval, forecasting) as Spark DataFrame operators."""

__version__ = "0.1.0"
