"""newsflow: news and document analytics as Spark DataFrame jobs.

``functions``  column expressions (URLs, text, scores, arrays, HTML)
``sources``    table, feed and page readers; upsert, export and snapshot sinks
``operators``  DataFrame -> DataFrame operators
``plans``      stages composed of operators, and the registered queries
``streaming``  the Structured Streaming front end
"""
