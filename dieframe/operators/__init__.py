"""DataFrame operators: rules, merging, joins, statistics, grouping, report tables and plot data."""
