"""shelfspark: supply-chain analytics as Spark DataFrame operators."""
