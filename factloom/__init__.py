"""factloom: evidence, knowledge-graph and corpus analytics as plain PySpark DataFrame transformations."""
