"""linkloom: organise bookmark collections and crawled pages with Spark.

Every step is a ``DataFrame -> DataFrame`` function that chains with
``DataFrame.transform``; the heavy lifting (grouping, joins, ranking,
vector maths, clustering) runs as distributed Spark jobs.
"""

__version__ = "0.1.0"
