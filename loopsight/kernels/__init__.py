"""NumPy functions on one frame or one sequence; nothing here knows of Spark."""
