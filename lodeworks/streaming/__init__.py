"""Change data as a stream of bounded windows."""
