"""Expression trees over a panel and their compilation to columns; the expression language."""
