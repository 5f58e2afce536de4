"""DataFrame-to-DataFrame jobs: lazy, no collect, no sort except where the order is the feature."""
