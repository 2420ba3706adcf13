"""tessera: a PySpark-native knowledge-ledger and retrieval-analytics engine."""
