"""Analytics over tracking, event and other irregular time-series tables, as plans of Spark DataFrames."""
