"""Run analytics on Spark: tasks, answers, messages, pages and event streams as DataFrame jobs."""
