"""Detectors that keep state from one measurement to the next, over streams and over tables."""
