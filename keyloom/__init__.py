"""Keyed-table reconciliation, change-log apply and schema convergence on PySpark."""
