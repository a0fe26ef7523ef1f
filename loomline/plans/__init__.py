"""Rules, pipelines and their execution: artifacts addressed by the lineage that makes them."""
