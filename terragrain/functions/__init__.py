"""Scalar functions over points, boxes, coordinates and pixel types."""
