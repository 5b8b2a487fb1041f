"""Quality control of sequencing reads as Spark DataFrame transformations."""
