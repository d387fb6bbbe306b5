"""refspark: judging quantitative evidence over Spark tables."""
