"""Operators: tessellation, geometry, walls, sections, moving points, physics, optimisers."""
