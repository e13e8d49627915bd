"""Threadloom: analytics over embroidery stitch plans on Spark."""
