"""Query plans over the provided tables (the registry used by the driver and the bench)."""
