"""panelcast: panel time-series features, extrapolation and boosted-tree
forecasting as Spark DataFrame plans."""
