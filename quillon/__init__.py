"""quillon: evidence analytics over attributable document collections, as DataFrame and SQL plans on Spark."""
