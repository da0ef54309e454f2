"""Named queries over the warehouse tables with their SQL twins."""
