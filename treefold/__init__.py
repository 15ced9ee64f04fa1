"""treefold: exact duplicate analysis over directory trees and tree-shaped tables, on Spark."""

__version__ = "0.1.0"
