"""gristmill: corpus preparation, scoring and packing as lazy Spark DataFrame transforms."""
