"""citeweave: citation-network and embedding analytics as Spark DataFrame operators.

Every public operator takes DataFrames (plus plain parameters) and returns a
DataFrame; the heavy work runs on executors through Catalyst plans, with
Arrow-batched pandas functions only where built-in expressions cannot say it.
"""

__version__ = "0.1.0"
