"""playtape: ordered event logs, price tapes and look-ahead-free backtests on Spark DataFrames."""
