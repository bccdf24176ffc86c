"""Column-level functions: no shuffles, no Python workers."""
