"""Operators of a large-scale training-data pipeline, as Spark jobs.

Every operator takes DataFrames and returns DataFrames; imperative work sits in Arrow batch functions that Spark
partitions and shuffles.  Nothing outside this subpackage imports it.
"""
