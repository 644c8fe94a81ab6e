"""Supply-chain analytics and data processing on PySpark."""
