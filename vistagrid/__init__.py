"""vistagrid: scenic tile scoring, route quality and product analytics on Spark DataFrames."""
