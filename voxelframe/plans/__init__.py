"""Plan-time objects: grids that are fitted by an aggregate and then label rows with Columns."""
