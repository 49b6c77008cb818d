"""Test tables as packets, pipelines and links, and the registered queries over them."""
