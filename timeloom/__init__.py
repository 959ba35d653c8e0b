"""Analytics over time-indexed media libraries, as pure functions from DataFrames to DataFrames."""
