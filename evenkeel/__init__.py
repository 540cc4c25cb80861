"""evenkeel: table reconciliation as lazy Spark DataFrame operators."""
