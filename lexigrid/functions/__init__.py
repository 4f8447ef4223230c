"""Column expressions: vectors, kernels, losses, schedules."""
