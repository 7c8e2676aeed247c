"""quirewise: document-collaboration analytics and corpus preparation on Spark."""
