"""Plans built from the operators: the driver tables' projection, the close, the scorer, the workload."""
