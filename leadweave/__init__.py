"""Business-lead preparation and lead-table queries as PySpark DataFrame operators."""
