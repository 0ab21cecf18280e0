"""Evidence reconciliation on Spark: votes, decisions, partitions, certificates, compaction."""
