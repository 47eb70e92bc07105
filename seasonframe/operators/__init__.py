"""DataFrame operators. Column names are parameters, so that they run on any table of observations."""
