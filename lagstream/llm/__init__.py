"""Training-data operators. Nothing outside this folder imports it; see registry.py for its queries."""
