"""cellweave: Voronoi and power tessellations of point sets as Spark DataFrames."""

__version__ = "0.1.0"
