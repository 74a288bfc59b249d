"""Readers and writers of frames, scores, box blobs and stages."""
