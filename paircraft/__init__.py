"""paircraft: duplicate-text pair analytics as Spark DataFrame operators.

Sub-packages
------------
sources     table readers/writers, metric log, fixture views over the test tables
functions   column expressions (text cleaning, similarity, binning, hashing)
operators   DataFrame -> DataFrame operators (split, EDA, TF-IDF, KNN, features,
            experts, gate, metrics)
plans       reusable distributed plan shapes (ordered cumulative sums, exact
            quantiles, neighbour-in-group) and the registered queries
streaming   incremental reading of the append-only metric log
"""

__version__ = "0.1.0"
