"""Knowledge-record, event-log and session jobs for Spark."""
