"""ionloom: peak-table analytics as Spark DataFrame jobs."""
