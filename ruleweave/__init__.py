"""ruleweave: rule-based risk analytics on Spark DataFrames.

Every public function takes and returns ``pyspark.sql.DataFrame`` objects and
is built from Spark SQL expressions, joins, aggregates and windows (plus
Spark ML estimators for the model steps).  Subpackages:

* ``sources``   – table loading, CSV survey reader, model IO, report sink,
                  and the stand-in inputs built from the driver test tables.
* ``functions`` – column-level helpers: ordered levels, recodes, casts,
                  right-closed binning, t quantiles, rule rendering.
* ``operators`` – sampling/splits, rule matching, grouped statistics, AUC,
                  calibration, reshape, densities.
* ``plans``     – the composed analyses: rule subpopulation report, expert
                  disagreement, model augmentation, learning curve.
* ``models``    – Spark ML fits and scoring, tree-to-rule extraction.
* ``streaming`` – rule matching / scoring on streaming DataFrames.
"""

__version__ = "0.1.0"
