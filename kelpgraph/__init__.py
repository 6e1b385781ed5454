"""kelpgraph: a property graph of source trees and documents, on Spark DataFrames."""

__version__ = "0.1.0"
