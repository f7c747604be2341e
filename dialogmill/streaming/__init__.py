"""Live counterparts of the batch jobs."""
