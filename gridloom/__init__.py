"""gridloom: event alignment, order-book pricing and signal replay on Spark DataFrames."""
