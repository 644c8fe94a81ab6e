"""Ready-made plans: the stand-in tables and the registered queries with their SQL."""
