"""voxloom: 3-D shape analytics as relational plans on Spark."""
