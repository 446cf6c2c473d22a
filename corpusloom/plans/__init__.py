"""Ready-made plans and their SQL equivalents."""
