"""Table work around classifiers, as PySpark DataFrame operators."""
