"""Spark jobs for probabilistic top-k analytics over scored frames and clips."""
