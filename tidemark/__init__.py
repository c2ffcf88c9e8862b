"""Tidemark: causal features, ranking metrics and score fusion as Spark plans."""
