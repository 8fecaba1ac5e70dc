"""Sources and sinks of trajectories, topologies and results."""
