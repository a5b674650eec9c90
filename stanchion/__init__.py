"""Detection and event analytics on Spark: association, zones, alerts, similarity, metrics and statistics as DataFrame operators."""
