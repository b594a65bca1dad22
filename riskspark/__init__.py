"""riskspark: a Spark-native engine for tabular risk scoring and score-history analytics.

Every operator is a function ``f(df, ...) -> DataFrame`` built from DataFrame / SQL
expressions so Catalyst can prune, push down and plan it; nothing is collected to the
driver except scalars that fix a plan (bucket boundaries, fitted parameters).
"""

__version__ = "0.1.0"
