"""tracelake: Spark-first retrieval and event analytics over time-stamped observations."""
