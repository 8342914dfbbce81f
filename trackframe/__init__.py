"""trackframe: windowed trajectory analytics and corpus preparation on Spark."""
