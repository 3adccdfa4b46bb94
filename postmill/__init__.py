"""postmill: mailbox analytics and corpus preparation as Spark jobs."""
