"""Plan shapes that keep hot keys and long log partitions spread over many tasks."""
