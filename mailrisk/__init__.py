"""Mail-threat analytics on Spark: raw mail to tables, evidence signals, scores and evaluation."""
