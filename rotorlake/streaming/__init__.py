"""Progress of running sweeps. The engine has no unbounded sources."""
