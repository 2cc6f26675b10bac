"""The job that handles new arrivals once they stop changing."""
