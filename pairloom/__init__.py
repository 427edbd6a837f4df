"""pairloom: fine-tuning tables (preference, instruction, chat, tool-calling, image-caption) on Spark.

Every operator takes a DataFrame and returns a DataFrame built from Spark SQL expressions, so a
whole preparation is one plan that Catalyst optimises and the cluster runs in parallel.
"""

__version__ = "0.1.0"
