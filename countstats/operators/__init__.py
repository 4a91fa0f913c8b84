"""DataFrame operators: preparation, groups, estimators, tests, p-values, intervals, reshaping."""
