"""Column expressions shared by the views."""
