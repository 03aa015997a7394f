"""Depth-profiled field surveys on Spark: soil cores, vegetation plots, sites.

Every public function takes and returns DataFrames (or Columns), so they chain
with ``df.transform``.  Layers:

* ``functions`` - null-aware column expressions
* ``operators`` - generic summaries, joins, reshapes, quantiles and models
* ``sources``   - readers, writers and the mapping of the driver tables
* ``plans``     - the carbon computations themselves
* ``catalog``   - the registered queries and their SQL twins
"""
