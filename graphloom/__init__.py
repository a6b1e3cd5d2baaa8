"""Code-graph analytics on PySpark: relational operators over snapshot-versioned symbol graphs."""
