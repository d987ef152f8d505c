"""Demographic table analytics on Spark.

Every public function takes DataFrames and returns a lazy DataFrame (or takes
and returns Columns), so a whole analysis is one Spark plan. Functions accept
``keys``, extra grouping columns such as country, region or scenario, so that
one call covers many populations.
"""

__version__ = "0.1.0"
