"""Whole jobs: options, the gridding plan, and views of tables as point clouds."""
