"""ledgerlens: DataFrame-in, DataFrame-out analytics for account ledgers on Spark."""
