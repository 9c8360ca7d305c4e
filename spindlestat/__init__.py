"""Quality statistics on Spark DataFrames: control charts, measurement systems, process capability."""
