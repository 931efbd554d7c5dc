"""Whole runs: propagation of known labels, detection by a labeller, sweeps."""
