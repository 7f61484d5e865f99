"""ledgerlark: expense-evidence analytics expressed as Spark DataFrame programs."""
