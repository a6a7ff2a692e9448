"""Sales and stock analytics on PySpark.

Every operator is a lazy DataFrame -> DataFrame function; see README.md for the
map from operator to module.
"""
