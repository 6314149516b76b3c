"""Release jobs that chain the operators over written layers."""
