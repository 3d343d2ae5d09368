"""quillon: a Spark-first analytics engine for recommendation data, rollout
analytics and training-corpus preparation.  Every operator takes and returns
DataFrames; planning is left to Catalyst and adaptive execution."""

__version__ = "0.1.0"
