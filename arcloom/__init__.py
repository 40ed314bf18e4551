"""arcloom: graph, temporal-interaction and ranking analytics expressed as Spark DataFrame plans."""
