"""Analytics over version-controlled object graphs on Spark."""
