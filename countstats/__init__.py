"""Count-matrix statistics and table work as PySpark DataFrame operators."""
