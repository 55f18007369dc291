"""Empty on purpose: every input is a finished yearly file, so the workload is batch only."""
