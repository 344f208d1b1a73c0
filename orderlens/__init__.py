"""Order-delivery and customer-experience analytics as Spark DataFrame jobs."""
