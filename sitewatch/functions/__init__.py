"""Column-to-column helpers; every function stays inside Catalyst."""
