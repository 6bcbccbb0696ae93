"""pitlake: point-in-time analytics and record matching as Spark plans."""
