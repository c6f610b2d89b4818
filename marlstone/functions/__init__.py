"""Part of the marlstone analytics engine."""
