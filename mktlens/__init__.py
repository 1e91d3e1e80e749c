"""mktlens: marketplace analytics on Spark.

Snapshots of product SKUs -> mergeable daily states -> period rollups and the
analytic queries over them, all as DataFrame functions (see README.md).
"""

__version__ = "0.1.0"
