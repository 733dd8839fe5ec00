"""Session handling, the end-to-end merge, and the registered workload."""
