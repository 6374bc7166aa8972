"""A Spark-native engine for spatial, ecological and embedding data.

functions: column expressions. operators: DataFrame in, DataFrame out. sources: readers
and writers. plans: registered queries. streaming: Structured Streaming forms.
"""
