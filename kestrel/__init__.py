"""kestrel: supply-chain analytics as Spark DataFrame jobs.

Every public operator takes DataFrames (plus parameters) and returns a
DataFrame; no operator runs an action except model fitting and sinks.
"""

__version__ = "0.1.0"
