"""The chains of operators behind the usual reports."""
