"""Whole workloads, and the mapping of the driver's tables to the library's contracts."""
