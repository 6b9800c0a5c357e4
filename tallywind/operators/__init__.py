"""DataFrame operators: series, evaluation, frequencies, search, panels, publishing."""
