"""Part of graphloom, a knowledge-graph and corpus engine on PySpark."""
