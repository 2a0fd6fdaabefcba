"""A PySpark-native engine for invoice reconciliation and its analytics."""
