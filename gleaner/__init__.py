"""Feed monitoring as Spark jobs: normalise, de-duplicate, filter, score, route and report."""
