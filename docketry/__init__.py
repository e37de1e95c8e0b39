"""docketry: a Spark-first analytics engine for legal and civic data."""
