"""DataFrame operators: nearest neighbours, log folds, index tables."""
