"""A Spark-native engine that treats a table as its own work queue: blank outputs are what is still to be done."""
