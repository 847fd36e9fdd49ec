"""Operators on voxel tables."""
