"""trovekit: build, search and evaluate multimodal retrieval collections on Spark.

Everything is a DataFrame -> DataFrame function.  See README.md for the map of
the package.
"""

__version__ = "0.1.0"
