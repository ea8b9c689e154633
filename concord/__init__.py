"""Document reconciliation and case analytics as Spark DataFrame jobs."""
