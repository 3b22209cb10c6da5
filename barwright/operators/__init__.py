"""DataFrame operators on bars, signals and trades."""
