"""Gridding of point streams."""
