"""Category recipes, and the jobs that run them."""
