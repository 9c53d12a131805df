"""Restaurant order, menu and stock analytics as Spark jobs."""
