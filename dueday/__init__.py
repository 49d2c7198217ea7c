"""Credit-risk analytics as Spark jobs: cleaning, labels, history features,
splits, tree models and evaluation tables, all as DataFrame operators."""
