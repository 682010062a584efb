"""Micro-batch drivers over versioned tables."""
