"""DataFrame operators: conversation shaping, grouping, joins, selection, probability."""
