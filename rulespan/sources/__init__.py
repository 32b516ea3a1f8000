"""Reading and staging tables and documents."""
