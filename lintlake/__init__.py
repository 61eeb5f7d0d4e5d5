"""Code-security findings and corpus analytics as Spark jobs."""
