"""DataFrame -> DataFrame operators and fit/transform estimators."""
