"""Collection building, sampling, statistics, search, codes and evaluation."""
