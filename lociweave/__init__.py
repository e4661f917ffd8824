"""lociweave: Spark-native analytics for genomic-interval dataflows."""
