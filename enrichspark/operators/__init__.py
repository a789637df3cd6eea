"""DataFrame-in, DataFrame-out operators. Each one handles every entity in a single job."""
